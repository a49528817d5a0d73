"""Documents with every edge at once, and brute-force helpers."""

EXTRA = "t string, h string, d string, bucket string, fp string, rank string, spans string, _p string, _tokens string, _0 string, p_toxic string, label string, shard string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def docs(spark, rows):
    """rows: (doc_id, text); the other columns have clashing names and are filled or null by turns."""
    full = [(i, t, "en" if n % 3 else None, f"s{n % 2}" if n % 4 else None, None if t is None else len(t), *(("x",) * 13 if n % 2 else (None,) * 13)) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


LONG = " ".join(f"w{i * i % 977}x{i}" for i in range(15_000))
EDGES = [(5, None), (3, ""), (7, "   \n\t "), (1, "one"), (2, "one two"), (4, "one two three. Four\nfive"), (4, "one two three. Four\nfive"), (None, "no id at all"), (8, LONG), (9, "Ünï cödé → ✓\n\nsecond"), (6, "one two three. Four\nfive"), (10, LONG[:2000])]


def connected(nodes, linked):
    """Smallest reachable node of each, by brute force."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
