"""Secret scans: fixed patterns, and two character Markov models.

Patterns find assignments, access keys and hexadecimal runs. Other runs of key characters are scored
by the log-likelihood ratio of two first-order Markov models over characters: one of random strings
and one of ordinary identifiers. Both are trained from labelled samples of the corpus: what the patterns
find is random, other runs in documents of the sample are ordinary.

Only DataFrame expressions are used. Spark's functions return matched strings, not places; the places are
the running sums of the lengths of matches and of the gaps between them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribeprint.llm.quality_rules import let
from scribeprint.llm.scratch import as_text, free_name, quoted, without

# Kinds in their order, what they match, and the fewest characters.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs are taken whole, so short ones can be left out by the pattern itself
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1  # and the start
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ORDINARY = r"[A-Za-z0-9+/_=-]{4,}"
#: Least log-likelihood ratio of a secret, in all and for each character.
MIN_RATIO, MIN_MEAN = 12.0, 0.5
#: Share of even chance in the model of random strings: samples are often of one kind, such as hexadecimal.
EVEN = 0.5
#: The models are fitted on documents with the smallest hash of their id: at most so many that may hold
#: secrets, and so many for ordinary identifiers.
SECRET_DOCS, ORDINARY_DOCS = 50_000, 5_000
#: Matches whose places are summed up in one go.
STRETCH = 512
#: Pieces of a text that are cut from one stretch of it.
FAN = 64
SPANS = "array<struct<start:bigint,end:bigint>>"
MASK = "[secret]"
ADDED = ("n_assign", "n_access", "n_hex", "base_spans", "spans")


def _places(text: Column, pattern: str, keep=None) -> Column:
    """Spans of all matches, leftmost first. Sums run in stretches, so long lists are not copied again and again."""
    none = F.array().cast(SPANS)

    def add(state: Column, i: Column, gaps: Column, found: Column) -> Column:
        start = state["at"] + F.length(F.get(gaps, i))
        end = start + F.length(F.get(found, i))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        good = span if keep is None else F.when(keep(F.get(found, i)), span).otherwise(none)
        return F.struct(end.alias("at"), F.concat(state["spans"], good).alias("spans"))

    def stretch(state: Column, k: Column, gaps: Column, found: Column) -> Column:
        first = k * STRETCH
        own = F.aggregate(F.sequence(first, F.least(first + STRETCH, F.size(found)) - 1),
                          F.struct(state["at"].alias("at"), none.alias("spans")),
                          lambda s, i: add(s, i, gaps, found))
        return let(own, lambda o: F.struct(o["at"].alias("at"),
                                           F.concat(state["parts"], F.array(o["spans"])).alias("parts")))

    def walk(x: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPANS}>").alias("parts"))
        steps = F.sequence(F.lit(0), F.floor((F.size(x["found"]) - 1) / STRETCH).cast("int"))
        return F.flatten(F.aggregate(steps, begin, lambda s, k: stretch(s, k, x["gaps"], x["found"]))["parts"])

    both = F.struct(F.split(text, pattern, -1).alias("gaps"),
                    F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"))
    return F.when(text.rlike(pattern), let(both, walk)).otherwise(none)


def scan(items: Column, begin: Column, step, kind: str) -> Column:
    """What ``step`` gives for each item in turn, one after another: arrays of type ``kind``.

    ``step(state, item, next)`` returns ``struct(state, out)``; ``next`` is null for the last item. As in ``_places``,
    results are gathered in stretches.
    """
    none = F.array().cast(kind)

    def add(s: Column, i: Column, xs: Column) -> Column:
        return let(step(s["state"], F.get(xs, i), F.get(xs, i + 1)), lambda r: F.struct(
            r["state"].alias("state"), F.concat(s["out"], r["out"]).alias("out")))

    def stretch(s: Column, k: Column, xs: Column) -> Column:
        first = k * STRETCH
        own = F.aggregate(F.sequence(first, F.least(first + STRETCH, F.size(xs)) - 1),
                          F.struct(s["state"].alias("state"), none.alias("out")), lambda s, i: add(s, i, xs))
        return let(own, lambda o: F.struct(o["state"].alias("state"), F.concat(s["parts"], F.array(o["out"])).alias("parts")))

    def walk(xs: Column) -> Column:
        first = F.struct(begin.alias("state"), F.array().cast(f"array<{kind}>").alias("parts"))
        steps = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / STRETCH).cast("int"))
        return F.flatten(F.aggregate(steps, first, lambda s, k: stretch(s, k, xs))["parts"])

    return let(items, lambda xs: F.when(F.size(xs) > 0, walk(xs)).otherwise(none))


def long_value(match: Column) -> Column:
    """Whether an assignment's value has the fewest characters."""
    return F.length(F.regexp_extract(match, ASSIGN, 1)) >= ASSIGN_VALUE


def _codes(token: Column) -> Column:
    """Places of the characters in ``ALPHABET``, from 1, after a 0 for the start."""
    return F.concat(F.array(F.lit(0)), F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c)))


def _steps(token: Column) -> Column:
    """Numbers of the transitions of a token, start included."""
    return let(_codes(token), lambda c: F.transform(
        F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.get(c, i - 1) * STATES + F.get(c, i)))


def _counts(tokens: Column, docs: DataFrame) -> dict[int, int]:
    """Transitions of all tokens: at most ``STATES`` squared rows."""
    rows = (docs.select(F.explode(tokens).alias("token")).filter("length(token) > 0")
            .select(F.explode(_steps(F.col("token"))).alias("step")).groupBy("step").count().collect())
    return {r["step"]: r["count"] for r in rows}


def _logs(counts: dict[int, int], even: float) -> list[float]:
    """Log-probability of every transition, with one added to every count, mixed with ``even`` parts of chance."""
    out = []
    for a in range(STATES):
        row = [counts.get(a * STATES + b, 0) + (b > 0) for b in range(STATES)]
        out += [math.log((1 - even) * n / sum(row) + even / len(ALPHABET)) if n else 0.0 for n in row]
    return out


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", secret_docs: int = SECRET_DOCS,
          ordinary_docs: int = ORDINARY_DOCS) -> list[float]:
    """Log ratios (random to ordinary) of all transitions, from the documents with the smallest hashes of their id."""
    hashed = F.xxhash64(F.col(doc_id).cast("string"))
    own = as_text(text)

    def sample(n: int) -> DataFrame:
        cut = docs.select(hashed.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
        return docs.filter(hashed <= F.lit(cut) if cut is not None else F.lit(False))

    values = F.regexp_extract_all(own, F.lit(ASSIGN), 1)
    random = F.filter(F.concat(F.filter(values, lambda v: F.length(v) >= ASSIGN_VALUE),
                               F.regexp_extract_all(own, F.lit(ACCESS), 0),
                               F.regexp_extract_all(own, F.lit(HEX), 0)), lambda v: ~v.contains("."))
    any_base = own.rlike(ASSIGN) | own.rlike(ACCESS) | own.rlike(HEX)
    found = _counts(random, sample(secret_docs).filter(any_base))
    usual = _counts(F.regexp_extract_all(own, F.lit(ORDINARY), 0), sample(ordinary_docs).filter(~any_base))
    return [a - b for a, b in zip(_logs(found, EVEN), _logs(usual, 0.0))]


def ratio(token: Column, model: Column) -> Column:
    """Log-likelihood ratio of a token: above 0 is more like a random string."""
    return F.aggregate(_steps(token), F.lit(0.0), lambda s, k: s + F.get(model, k))


def model_column(ratios: list[float]) -> Column:
    return F.expr("array(" + ", ".join(f"{r!r}D" for r in ratios) + ")")


def _tag(spans: Column, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end")))


def find_secrets(docs: DataFrame, ratios: list[float] | None = None, doc_id: str = "doc_id",
                 text: str = "text", **sample) -> DataFrame:
    """``docs`` with ``n_assign, n_access, n_hex, base_spans, spans``.

    Spans are ``struct(kind, start, end)`` in code points, end excluded, by start, then kind in the order of
    ``KINDS``. ``base_spans`` are those of the patterns, ``spans`` has the Markov models' as well: runs of key
    characters that overlap no pattern's span and look random. ``ratios``: a model of ``train``; without one
    it is trained on ``docs``.

    Null or empty text has no spans. Repeated rows are scanned each by itself, though they count in
    training as often as they stand. Texts are read whole, an empty table stays empty, ids may be
    null, and columns with the names of the result are replaced.
    """
    if ratios is None:
        ratios = train(docs, doc_id, text, **sample)
    base = without(docs, *(c for c in ADDED if c != text))
    own = as_text(text)
    found = {"assign": _places(own, ASSIGN, long_value), "access": _places(own, ACCESS), "hex": _places(own, HEX)}
    names = {k: free_name(base, f"{k}_") for k in KINDS}
    out = base.withColumns({names[k]: v for k, v in found.items()})
    model = model_column(ratios)
    looks_random = lambda m: let(ratio(m, model), lambda r: (
        r >= F.greatest(F.lit(MIN_RATIO), MIN_MEAN * F.length(m))))
    out = out.withColumn(names["markov"], _places(own, CANDIDATE, looks_random))
    tagged = {k: _tag(F.col(names[k]), n) for n, k in enumerate(KINDS)}

    def listed(spans: Column) -> Column:
        kinds = F.array(*map(F.lit, KINDS))
        return F.transform(F.array_sort(spans), lambda s: F.struct(
            F.get(kinds, s["order"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    patterns = F.concat(*(tagged[k] for k in KINDS[:-1]))
    kind, markov = "array<struct<start:bigint,order:int,end:bigint>>", len(KINDS) - 1
    none = F.array().cast(kind)

    def alone(reached: Column, s: Column, after: Column) -> Column:
        """``reached``: the greatest end of a pattern's span so far. Of spans that start later, the next one is enough:
        the models' own spans do not overlap."""
        mine = s["order"] == markov
        met = (s["start"] < reached) | F.coalesce((after["order"] < markov) & (after["start"] < s["end"]), F.lit(False))
        return F.struct(F.when(mine, reached).otherwise(F.greatest(reached, s["end"])).alias("state"),
                        F.when(mine & ~met, F.array(s)).otherwise(none).alias("out"))

    apart = F.when(F.size(tagged["markov"]) > 0, scan(
        F.array_sort(F.concat(patterns, tagged["markov"])), F.lit(0).cast("long"), alone, kind)).otherwise(none)
    out = out.withColumns({
        **{f"n_{k}": F.size(names[k]).cast("long") for k in KINDS[:-1]},
        "base_spans": listed(patterns), "spans": listed(F.concat(patterns, apart))})
    return out.drop(*names.values())


def written_spans(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _kept(text: Column, at: Column, pieces: Column, depth: int) -> Column:
    """The ``pieces`` of a text with ``MASK`` between them; ``at`` is the place of the text in the whole.

    A substring is looked up from the start of its text, so many of them are first cut in stretches.
    """
    def cut(a: Column, b: Column) -> Column:
        return F.substring(text, (a - at + 1).cast("int"), (b - a).cast("int"))

    if not depth:
        return F.array_join(F.transform(pieces, lambda p: cut(p["from"], p["to"])), MASK)
    size = FAN ** depth

    def stretch(k: Column) -> Column:
        own = F.slice(pieces, k * size + 1, F.lit(size))
        begin = lambda s: F.get(s, F.lit(0))["from"]
        return let(own, lambda s: let(cut(begin(s), F.element_at(s, -1)["to"]),
                                      lambda t: _kept(t, begin(s), s, depth - 1)))

    steps = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / size).cast("int"))
    return F.array_join(F.transform(steps, stretch), MASK)


def mask_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars",
                 **options) -> DataFrame:
    """``docs`` with every span, or union of spans that overlap or touch, replaced by ``MASK``.

    ``n_chars``, if there is such a column, is counted anew for changed texts. Null texts stay null, empty ones
    and those without secrets as they are. Repeated rows are masked each by itself, an empty table stays empty, ids may
    be null, and other columns stay whatever their names.
    """
    found = find_secrets(docs, doc_id=doc_id, text=text, **options)

    def merge(state: Column, s: Column, after: Column) -> Column:
        new = s["start"] > state["end"]
        own = F.struct(F.when(new, s["start"]).otherwise(state["start"]).alias("start"),
                       F.when(new, s["end"]).otherwise(F.greatest(state["end"], s["end"])).alias("end"))
        return let(own, lambda o: F.struct(o.alias("state"), F.when(
            F.coalesce(after["start"] > o["end"], F.lit(True)), F.array(o)).otherwise(F.array().cast(SPANS)).alias("out")))

    begin = F.struct(F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))
    # What stays: from the end of a span (or the begin of the text) to the start of the next (or the end).
    kept = let(scan(F.col("spans"), begin, merge, SPANS), lambda m: F.transform(
        F.sequence(F.lit(0), F.size(m)), lambda i: F.struct(
            F.coalesce(F.get(m, i - 1)["end"], F.lit(0).cast("long")).alias("from"),
            F.coalesce(F.get(m, i)["start"], F.length(text).cast("long")).alias("to"))))
    hit = F.size("spans") > 0
    few = lambda p: _kept(F.col(text), F.lit(0).cast("long"), p, 0)
    many = lambda p: _kept(F.col(text), F.lit(0).cast("long"), p, 2)
    clean = F.when(hit, let(kept, lambda p: F.when(F.size(p) <= FAN, few(p)).otherwise(many(p)))).otherwise(F.col(text))
    name = free_name(found, "clean_")
    out = found.withColumn(name, clean)
    changed = {text: F.col(name)}
    if n_chars and n_chars in docs.columns:
        changed[n_chars] = F.when(hit, F.length(name).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars))
    return out.withColumns(changed).select(*quoted(docs))
