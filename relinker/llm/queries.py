"""The registered queries of this package: each applies one operator to a whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relinker.llm import align, bpe, langid, merkle, minhash, mixing, pii, quality, secrets, tokenfile, topk, vectordup, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"))


def op2_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op3_vectordup(spark, sf_dir):
    return vectordup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_tokenfile(spark, sf_dir):
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_langid(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    return quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.tokenizer_path("word_bpe_49k.json"))


def op11_align(spark, sf_dir):
    return align.links(table(spark, sf_dir, "documents"), bpe.tokenizer_path("byte_bpe_50k.json"), bpe.tokenizer_path("piece_bpe_32k.model"))


def op12_merkle(spark, sf_dir):
    return merkle.verified(table(spark, sf_dir, "documents"))


def op13_secrets(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_topk": op1_topk,
        "op2_pii": op2_pii,
        "op3_vectordup": op3_vectordup,
        "op4_tokenfile": op4_tokenfile,
        "op5_mixing": op5_mixing,
        "op6_warc": op6_warc,
        "op7_minhash": op7_minhash,
        "op8_langid": op8_langid,
        "op9_quality": op9_quality,
        "op10_bpe": op10_bpe,
        "op11_align": op11_align,
        "op12_merkle": op12_merkle,
        "op13_secrets": op13_secrets,
    }


# The digest of 20 bytes in base32: four numbers of 40 bits, eight digits of five bits each.
_DIGIT = (
    "list_reduce(list_transform([35, 30, 25, 20, 15, 10, 5, 0], lambda s: "
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, {at}, 10))::BIGINT >> s) & 31 AS INTEGER) + 1, 1)), "
    "lambda x, y: x || y)")

OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS h FROM p),
m AS (SELECT h, max(page_id) AS last FROM d GROUP BY h)
SELECT page_id, payload_bytes, {" || ".join(_DIGIT.format(at=10 * i + 1) for i in range(4))} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d JOIN m USING (h)
"""


def _merkle_sql(heights: int = 8) -> str:
    """Level by level from the leaves; trees that have reached one node stay as they are."""
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(
            f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
            for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def levels(name: str, start: str) -> str:
        """From (tree, n, pos, digest), tables name0, name1, ... and the runs between them."""
        out = [f"{name}0 AS ({start})"]
        for h in range(heights):
            out.append(
                f"{name}run{h} AS (SELECT tree, n, pos // 8 AS up, list(digest ORDER BY pos) AS run FROM {name}{h} GROUP BY ALL)")
            out.append(
                f"{name}{h + 1} AS (SELECT tree, (n + 7) // 8 AS n, up AS pos, "
                f"CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS digest FROM {name}run{h})")
        return ", ".join(out)

    def climb(name: str, before: str, place: str, h: int) -> str:
        """One height of the proof: ``s`` siblings so far, ``f`` the digest folded so far."""
        k = f"CAST(({place} // {8 ** h}) % 8 AS INTEGER)"
        return (
            f"SELECT b.* REPLACE (CASE WHEN r.n = 1 THEN s ELSE s || array_to_string(list_concat(run[:{k}], run[{k} + 2:]), '') END AS s, "
            f"CASE WHEN r.n = 1 THEN f ELSE sha256(array_to_string(run[:{k}], '') || f || array_to_string(run[{k} + 2:], '')) END AS f) "
            f"FROM {before} b JOIN {name}run{h} r ON r.tree = {'b.tree' if name == 'l' else '0'} AND r.up = {place} // {8 ** (h + 1)}")

    steps, last = [], "start"
    for name, place in (("l", "b.rank"), ("o", "b.tree")):
        for h in range(heights):
            steps.append(f"{name}step{h} AS ({climb(name, last, place, h)})")
            last = f"{name}step{h}"
    # The checksum of a byte: eight shifts, folded with the polynomial in reversed bit order.
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), "
        "lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295)")
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH leaves AS (
  SELECT doc_id, lang, {leaf("text")} AS leaf,
    CASE WHEN {crc} % 3 = 0 AND text IS NOT NULL THEN {leaf(lower)} ELSE {leaf("text")} END AS changed
  FROM documents),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank
  FROM leaves),
{levels("l", "SELECT tree, n, rank AS pos, leaf AS digest FROM placed")},
{levels("o", f"SELECT 0 AS tree, count(*) OVER () AS n, tree AS pos, digest FROM l{heights}")},
start AS (SELECT doc_id, tree, rank, leaf, '' AS s, changed AS f FROM placed),
{", ".join(steps)}
SELECT doc_id, leaf, t.digest AS subroot, r.digest AS root, sha256(s) AS proof_sha256, f AS folded_root, f = r.digest AS verified
FROM {last} JOIN l{heights} t USING (tree) CROSS JOIN o{heights} r
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6_SQL, "op12_merkle": _merkle_sql()}
