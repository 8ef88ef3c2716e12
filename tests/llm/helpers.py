"""Small tables with every awkward case, and how to run a query or its SQL twin over them."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

SMALL = "/root/testdata/sf0.001"
DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
WORDS = "the quick brown fox jumps over a lazy dog while seven grey wizards quietly mix strong potions near old stone bridges".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + k * k + k * seed) % len(WORDS)] + ("" if k % 5 else str(seed + k)) for k in range(n))


def awkward_docs() -> list[tuple]:
    """Nulls, empty and very long texts, case and white space, ties, repeated rows."""
    long = sentence(3, 20_000)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, "Word", "en", "b"), (5, "word", "en", "b"), (6, "WORD ", "fr", "b"), (7, "Élan É", "fr", None), (8, "élan É", "fr", None), (9, "élan é", "fr", None),
        (10, long, "en", "a"), (11, long.upper(), "en", "a"), (12, long + " x", "en", "c"), (13, sentence(5, 60), "en", "c"), (13, sentence(5, 60), "en", "c"), (14, sentence(5, 59), "en", "c"), (15, sentence(6, 200), "en", "b"),
        (16, sentence(6, 199) + " other", "en", "b"), (17, "line one here\nline one here\n\nline two", "en", "b"), (18, "123 456 --- !!!", None, "b"), (19, "日本語のテキスト 日本語", "ja", "d"), (20, "á á <|endoftext|> it's x<|startoftext|>y", "en", "d"),
        (21, "\u0000odd\u0085text here ß İ", "de", "d"), (22, "word " * 3000, "en", "d"), (23, "#*$%&|<> # **", "en", "d"), (24, "word", "de", "b"), (None, "no id", "en", "a"), (None, "no id", "en", "a"), (None, None, None, None),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def save(folder, **tables) -> str:
    """Write tables as the driver lays them out. documents: rows of DOCS; others: pyarrow tables."""
    for name, rows in tables.items():
        table = pa.Table.from_pylist([dict(zip(DOCS.names, r, strict=True)) for r in rows], schema=DOCS) if name == "documents" else rows
        pq.write_table(table, os.path.join(folder, f"{name}.parquet"))
    return str(folder)


def sql(folder: str, query: str) -> list[tuple]:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    found = con.execute(query)
    columns = [c[0] for c in found.description]
    return sorted((tuple(row[columns.index(c)] for c in sorted(columns)) for row in found.fetchall()), key=repr)


def rows_of(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def ascii_lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().split()]


def classes(keys: list, pairs: list[tuple]) -> dict:
    """The smallest key that each key reaches over pairs."""
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}
