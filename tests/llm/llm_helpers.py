"""Small inputs with the cases every operator must stand."""

LONG = "lorem ipsum dolor " * 30_000

#: Null and empty texts, blanks, ties, repeated rows, a null source, a very long text, a null id.
ODD = [
    (1, "one two three four five six", "en", "a", 27),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "  \t\n ", "en", None, 5),
    (5, "one two three four five six", "en", "b", 27),
    (5, "one two three four five six", "en", "b", 27),
    (6, LONG, "fr", "c", len(LONG)),
    (7, "été naïve 中文 😀", "fr", "c", 15),
    (None, "nobody's text, three words", None, "b", 26),
    (8, "12 34 -- !!", "de", "b", 11),
]
#: Columns an operator might use itself.
CLASHING = (
    "size", "target", "taken", "score", "n", "key", "t", "hash", "rank", "class", "component", "component_id", "weight",
    "label", "n_found", "sequence_id", "offset", "length", "kept", "least", "words", "lang_pred", "fingerprint", "bucket",
)


def odd_docs(spark):
    rows = [r + tuple(range(len(CLASHING))) for r in ODD]
    extra = ", ".join(f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def no_docs(spark):
    return odd_docs(spark).where("false")


def given(spark, name, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def classes(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    return {n: find(n) for n in nodes}


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    """Root of each text, all pairs compared."""
    sets = [plain_set(t) for t in texts]
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    return classes([(i, j) for j in range(len(sets)) for i in range(j) if near(sets[i], sets[j])], range(len(sets)))
