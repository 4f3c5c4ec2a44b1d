"""Small documents with every awkward case, and the synthetic table, for the operators' tests."""

import random

import duckdb

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, text_sha256 string, shard long, tokens array<string>"


def awkward() -> list[tuple[int | None, str | None]]:
    r = random.Random(5)
    words = [f"w{r.randrange(400)}" for _ in range(4000)]
    base = " ".join(words[:120])
    return [
        (7, None), (8, ""), (9, " \t\n "), (3, base), (12, base), (12, base), (13, base.replace("w", "W", 1)), (14, base + " tail"),
        (15, base.replace(" ", "\n ", 3)), (16, " ".join(words) * 20), (17, "é ß 中文 İ K 😀 " + base), (18, "x"), (19, "x y"),
        (20, "x y z"), (None, base), (None, None), (21, base), (-4, "-" * 60), (22, "-" * 60), (23, "a" * 300_000), (24, "sudden <|endoftext|> stop  "),
        (25, "tabs\tand  two  spaces \x0b\x0c \r\n ends "), (26, "\x1c \x1d\x85 　odd"), (27, "its 's 'll 123 456abc !!! ...\n\n\n  x"),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "d", "t", 1, ["t"]) for i, t in rows], SCHEMA)


def synthetic(name="documents", columns="doc_id, text") -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM read_parquet('{SF}/{name}.parquet')").fetchall()


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]


def same(got, expected):
    key = lambda x: tuple((v is None, str(type(v)), v if v is not None else 0) for v in x)
    assert sorted(got, key=key) == sorted(expected, key=key)
