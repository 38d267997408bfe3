"""The Merkle manifest beside a plain tree."""
import hashlib
import random
import zlib

import pytest

from relinker.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """Root, and per leaf its siblings by level."""
    proofs, digits = [[] for _ in leaves], [[] for _ in leaves]
    owner = [[i] for i in range(len(leaves))]
    nodes = list(leaves)
    while len(nodes) > 1:
        up, owners = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at:at + 8]
            for k in range(len(run)):
                for leaf in owner[at + k]:
                    proofs[leaf].append(run[:k] + run[k + 1:])
                    digits[leaf].append(k)
            up.append(sha("".join(run)))
            owners.append([x for o in owner[at:at + 8] for x in o])
        nodes, owner = up, owners
    return nodes[0], proofs, digits


def brute(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: (sorted(by_lang[x], key=lambda e: e[:3]), ) for x in langs}
    subs = {x: tree([e[2] for e in trees[x][0]]) for x in langs}
    root, top_proofs, top_digits = tree([subs[x][0] for x in langs])
    out = []
    for t, x in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(trees[x][0]):
            path = subs[x][1][i] + top_proofs[t]
            digits = subs[x][2][i] + top_digits[t]
            now = leaf
            if r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                now = leaf_of(r, "".join(c.lower() if c.isascii() else c for c in r["text"]))
            for run, k in zip(path, digits, strict=True):
                now = sha("".join(run[:k] + [now] + run[k:]))
            out.append((r["doc_id"], leaf, subs[x][0], root, sha("".join(s for run in path for s in run)), now, now == root))
    return sorted(out, key=str)


def check(spark, rows, **extra):
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    found = sorted(map(tuple, merkle.verified(docs.withColumns(extra)).collect()), key=str)
    assert found == brute(rows)


def make(n, langs, seed=1):
    r = random.Random(seed)
    return [{"doc_id": i * 3, "text": r.choice(["Ab c", "plain", "", None, "É Ünï 日本 X" * 3]), "lang": r.choice(langs),
             "source": r.choice(["s0", None, ""]), "n_chars": r.choice([None, i])} for i in range(n)]


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (9, ["en"]), (200, ["en", None, "ü", "z", "de"]), (90, ["en"] * 60 + [f"l{i}" for i in range(20)])])
def test_trees_equal_plain_trees(spark, n, langs):
    check(spark, make(n, langs))


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    rows = make(20, ["en", None])
    rows += [dict(rows[3])] * 17 + [{**rows[4], "text": "Another Text"}]
    rows += [dict.fromkeys(rows[0])] * 2
    rows += [{**rows[0], "doc_id": None, "text": "A" * 200_000}, {**rows[0], "doc_id": 2**53 + 1}]
    names = ("tree", "n", "pos", "digest", "rank", "piece", "path", "leaf", "changed", "_row", "_place")
    check(spark, rows, **{c: F.lit("x") for c in names})


def test_empty_table(spark):
    found = merkle.verified(spark.createDataFrame([], SCHEMA))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found.count() == 0


def test_proofs_of_some_rows(spark):
    """A few requests descend on their own and lead to the same root."""
    from pyspark.sql import functions as F

    rows = make(300, ["en", "de", None])
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    m = merkle.manifest(docs, F.lit(None).cast("string"))
    some = m.rows.where("rank % 17 = 5")
    found = merkle.proofs(m, some).select(merkle.folded(F.col("leaf"), F.col("path")).alias("r")).collect()
    assert len(found) == some.count() > 10
    assert {x["r"] for x in found} == {m.root}


def test_sql_equals_plain_trees():
    import duckdb
    import pandas as pd

    from relinker.llm import queries

    rows = make(300, ["en", None, "ü", "z", "de", *[f"l{i}" for i in range(9)]])
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows).astype({"doc_id": "int64", "n_chars": "Int64"}).astype({c: object for c in ("text", "lang", "source")}))
    con.execute("CREATE VIEW documents AS SELECT doc_id, text, lang, source, CAST(n_chars AS BIGINT) AS n_chars FROM given")
    assert sorted(con.execute(queries.oracle_sql()["op12_merkle"]).fetchall(), key=str) == brute(rows)
