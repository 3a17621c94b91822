"""Plain Python twins of the operators, written from their contracts."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
MARK_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def mark_words(text):
    return MARK_WORDS.findall((text or "").translate(LOWER))


def contamination(docs, items, size=10):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for (doc_id, text) rows."""
    windows = {}
    for item, text in items:
        words = mark_words(text)
        for k in range(max(1, len(words) - size + 1) if words else 0):
            windows.setdefault(tuple(words[k:k + size]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = mark_words(text), set(), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                own = windows.get(tuple(words[k:k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        names = sorted(str(i) for i in found)
        out.append((doc, len(words), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


LICENCE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by",
                   "mit license": "mit"}


def licence_phrases(text):
    """(n_words, n_base, first_word, last_word, base_labels)"""
    words, found = mark_words(text), []
    for phrase, label in LICENCE_PHRASES.items():
        own = phrase.split()
        found += [(k, label) for k in range(len(words)) if words[k:k + len(own)] == own]
    starts = [k for k, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in found})))


def blank_words(text):
    return BLANK_WORDS.findall(text or "")


def quality(docs):
    """doc_id -> (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    out = []
    for doc, text in docs:
        text = text or ""
        words = blank_words(text)
        lines = [x for x in text.split("\n") if BLANK_WORDS.search(x)]
        places = {}
        for k in range(len(words) - 7):
            places.setdefault(tuple(words[k:k + 8]), []).append(k)
        hit = {k + j for own in places.values() if len(own) > 1 for k in own for j in range(8)}
        out.append((doc, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
                    len(lines) - len(set(lines)), len(hit),
                    len(words) < 20 or 100 * len(hit) > 30 * len(words)))
    return out


def rejected_hosts(docs, deviations=2.0, limit=0.5, least=2.0, most=10_000.0):
    """Hosts of (doc_id, text, host) rows whose rate of one of the rules is too high after shrinking."""
    hosts = {}
    for (_, text, host), row in zip(docs, quality([(d, t) for d, t, _ in docs])):
        n_words, chars, symbols, dup, _, base = row[1:]
        n_lines = len([x for x in (text or "").split("\n") if BLANK_WORDS.search(x)])
        mean = chars / max(n_words, 1)
        hosts.setdefault(host, []).append((base, symbols > 0.1 * n_words, dup > 0.3 * n_lines, not 2 <= mean <= 20))
    out = set()
    noise = sum(1 / len(v) for v in hosts.values()) / max(len(hosts), 1)
    for rule in range(4):
        failed = {h: sum(x[rule] for x in v) for h, v in hosts.items()}
        rates = [failed[h] / len(v) for h, v in hosts.items()]
        mean = sum(rates) / len(rates) if rates else 0.0
        spread = (sum((r - mean) ** 2 for r in rates) / (len(rates) - 1) if len(rates) > 1 else 0.0) - mean * (1 - mean) * noise
        prior = min(max(mean * (1 - mean) / spread - 1, least), most) if spread > 0 else most
        for h, v in hosts.items():
            shrunk = (failed[h] + mean * prior) / (len(v) + prior)
            if shrunk - deviations * math.sqrt(shrunk * (1 - shrunk) / (len(v) + prior + 1)) > limit:
                out.add(h)
    return out


SECRET_PATTERNS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
                          r"([A-Za-z0-9+/_.=-]+)", re.ASCII), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def secrets(text):
    """(n_assign, n_access, n_hex, base_sha256)"""
    spans, counts = [], []
    for n, (kind, pattern, good) in enumerate(SECRET_PATTERNS):
        own = [m for m in pattern.finditer(text or "") if good(m)]
        counts.append(len(own))
        spans += [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in own]
    return (*counts, sha(",".join(s for *_, s in sorted(spans))))


def mix_targets(sizes):
    """source -> target, by filling again and again. ``sizes``: source -> words."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values())
    while left > 1e-9:
        open_ = [s for s in names if target[s] < 2 * sizes[s] - 1e-9]
        if not open_:
            break
        total, rest = sum(weight[s] for s in open_), 0.0
        for s in open_:
            want = target[s] + left * weight[s] / total
            rest += max(0.0, want - 2 * sizes[s])
            target[s] = min(want, 2 * sizes[s])
        left = rest
    return target


def repeats(docs, size=35):
    """(doc_id, n_words, n_removed, kept_sha256)"""
    places = {}
    all_words = [blank_words(text) for _, text in docs]
    for d, words in enumerate(all_words):
        for k in range(len(words) - size + 1):
            places.setdefault(tuple(words[k:k + size]), []).append((d, k))
    gone = [set() for _ in docs]
    for own in places.values():
        if len(own) > 1:
            for d, k in own:
                gone[d].update(range(k, k + size))
    return [(doc, len(words), len(g), sha(" ".join(w for k, w in enumerate(words) if k not in g)))
            for (doc, _), words, g in zip(docs, all_words, gone)]


def near(docs, percent=75):
    """(doc_id, n_shingles, component_id, kept); ids are unique"""
    sets = {}
    for doc, text in docs:
        words = blank_words((text or "").translate(LOWER))
        sets[doc] = ({tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5
                     else {tuple(words)} if words else set())
    up = {doc: doc for doc in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    at = {}
    for doc, own in sets.items():
        for shingle in own:
            at.setdefault(shingle, []).append(doc)
    tried = set()
    for own in at.values():
        for n, x in enumerate(own):
            for y in own[n + 1:]:
                if (x, y) not in tried:
                    tried.add((x, y))
                    both = len(sets[x] & sets[y])
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        a, b = sorted((root(x), root(y)))
                        up[b] = a
    return [(doc, len(own), root(doc), root(doc) == doc) for doc, own in sets.items()]


def archive(pages):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to)"""
    first = {}
    for page, html in pages:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, html in pages:
        data = (html or "").encode()
        again = data in first and first[data] != page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response",
                    first[data] if again else None))
    return out


def target_resampling(docs, target, buckets=10_000, low=1, high=1, seed=2024, min_words=20, percent=10):
    """Sorted (doc_id, n_words, n_features, weight, score, rank) of (doc_id, text) rows and target texts."""
    def found(text):
        words = mark_words(text)
        return words, [zlib.crc32(" ".join(words[k:k + n]).encode()) % buckets
                       for n in range(low, high + 1) for k in range(len(words) - n + 1)]

    own = [(d, *found(t)) for d, t in docs]
    s, t = Counter(b for _, _, v in own for b in v), Counter(b for x in target for b in found(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for doc, words, v in own:
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets))))
                     for b in v)
        h = int(hashlib.sha256(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(words), len(v), weight,
                    weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[:len(enough) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


def token_files(docs, encode, end_id=2):
    """(doc_id, start, n_tokens, ids_crc32), ids ascending and null first."""
    out, start = [], 0
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*encode(text or ""), end_id]
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def hard_negatives(rows, every=100, n_positives=5, n_negatives=10, low=30, high=90):
    """Sorted (anchor, positive, rank, negative, positive score, negative score) of (id, vector, label) rows."""
    used = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows
            if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, av, ac in used:
        if a is None or a % every:
            continue
        found = sorted(((-sum(x * y for x, y in zip(av, v)), i is None, i or 0, c) for i, v, c in used
                        if i != a and len(v) == len(av)))
        for score, none, p, _ in [f for f in found if f[3] == ac][:n_positives]:
            best = [f for f in found if f[3] != ac and low * -score <= 100 * -f[0] <= high * -score][:n_negatives]
            out += [(a, None if none else p, k + 1, None if n[1] else n[2], -score, -n[0])
                    for k, n in enumerate(best)]
    return sorted(out, key=repr)


def licence_notices(texts, templates, rare_words=16, min_rare=5, spread=0.25, min_score=0.6):
    """(labels, score) of the notices in each text, by counting and trying everything. ``templates``: (label, words,
    mandatory words); phrases that are labels by themselves come from ``licence_phrases``."""
    files = [mark_words(t) for t in texts]
    known = sorted({w for _, words, must in templates for w in [*words, *must]} | {
        w for p in LICENCE_PHRASES for w in p.split()})
    idf = {w: math.log((len(files) + 1) / (sum(w in f for f in map(set, files)) + 1)) + 1 for w in known}
    out = []
    for file in files:
        labels, score = set(), 0.0
        for label, words, must in templates:
            rare = sorted(set(words), key=lambda w: (-idf[w], w))[:rare_words]
            need, slack = min(min_rare, -(-len(rare) // 2)), max(4, int(spread * len(words)))
            starts = sorted((p - q, w) for p, w in enumerate(file) if w in rare for q, v in enumerate(words) if v == w)
            votes = {s: len({w for t, w in starts if s <= t <= s + slack}) for s, _ in starts}
            taken = []
            for s in sorted((s for s in votes if votes[s] >= need), key=lambda s: (-votes[s], s)):
                if any(abs(s - other) <= slack for other in taken):
                    continue
                taken.append(s)
                part = file[max(0, s - slack):max(0, s + len(words) + 2 * slack)]
                best = [0.0] * (len(part) + 1)
                for w in words:
                    new = best[:]
                    for j, x in enumerate(part):
                        new[j + 1] = max(new[j], best[j + 1], best[j] + idf[w] * (x == w))
                    best = new
                share = best[-1] / sum(idf[w] for w in words)
                if share >= min_score and any(part[j:j + len(must)] == must for j in range(len(part))):
                    labels.add(label)
                    score = max(score, share)
        out.append((labels, score))
    return out
