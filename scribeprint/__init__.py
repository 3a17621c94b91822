"""scribeprint: authorship analytics over tables of labelled text, on PySpark.

Sources read labelled samples into one DataFrame; functions are column
expressions; operators are ``DataFrame -> DataFrame`` jobs; plans put them
together into runs; streaming applies the stateless parts to unbounded input.
"""
