"""Merkle manifest and proofs against a brute-force version, and their defined cases."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quotemill.llm import merkle, queries
from quotemill.llm.common import settle
from quotemill.llm.ranks import ranked

from .test_operators import none, odd  # noqa: F401  fixtures

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
OUT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*(value(row[c]) for c in FIELDS))


def tree(digests, fan):
    """The root, and for each leaf its siblings, level by level, as (before, after)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // fan * fan : a // fan * fan + fan]
            paths[i].append(("".join(run[: a % fan]), "".join(run[a % fan + 1 :])))
            at[i] = a // fan
        level = [sha(*level[i : i + fan]) for i in range(0, len(level), fan)]
    return level[0], paths


def brute(rows, fan=16):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fan) for s in names}
    root, above = tree([trees[s][0] for s in names], fan) if names else (None, [])
    out = []
    for s, top in zip(names, above, strict=True):
        for (_, _, own, r), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            whole = path + top
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
                now = leaf(r | {"text": low})
            else:
                now = own
            for a, b in whole:
                now = sha(a, now, b)
            out.append((r["doc_id"], own, trees[s][0], root, sha(*(a + b for a, b in whole)), now, now == root))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in OUT) for r in df.collect()), key=repr)


def run(df, **more):
    return merkle.verify(df, hit=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, tampered={"text": merkle.ascii_lower(F.col("text"))}, **more)


def table(spark, sizes):
    rows, i = [], 0
    for s, n in sizes:
        for _ in range(n):
            i += 1
            rows.append({"doc_id": i * 7 % 1009 - 50, "text": [None, "", f"Text É {i}", "PLAIN A"][i % 4], "lang": None if i % 3 else "en", "source": s, "n_chars": None if i % 5 else i})
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)


@pytest.mark.parametrize(("sizes", "fan"), [
    ([("a", 300), (None, 17), ("", 16), ("b", 1), ("é", 33), ("Z", 2)], 16),
    ([(f"s{i}", 1 + i % 3) for i in range(40)], 16),
    ([("only", 257)], 16),
    ([("one", 1)], 16),
    ([("a", 30), ("b", 5), ("c", 1)], 2),
])
def test_proofs(spark, sizes, fan):
    rows, df = table(spark, sizes)
    assert got(run(df, fan=fan)) == brute(rows, fan)


def test_equal_rows_and_odd(spark, odd, none):
    rows, df = table(spark, [("a", 3), ("b", 40)])
    assert got(run(df.union(spark.createDataFrame([rows[1] | {"source": "hot"}] * 900, df.schema)))) == brute(rows + [rows[1] | {"source": "hot"}] * 900)
    odd = odd.withColumns({c: F.lit("x") for c in ("tree", "digest", "pos", "all", "children", "path", "changed")})
    rows = [r.asDict() for r in odd.collect()]
    assert got(run(odd)) == brute(rows)
    assert run(none).count() == 0 and run(none).columns == list(OUT)


def test_proof_of_single_rows(spark):
    rows, df = table(spark, [("a", 300), ("b", 40), ("c", 1)])
    made = merkle.build(df, group="source", key="doc_id", columns=list(FIELDS))
    asked = made.leaves.filter("pos in (0, 255, 299)")
    found = merkle.prove(made, asked).collect()
    root = made.root.first()["digest"]
    assert len(found) == 5 and all(r.reached == r.digest for r in found)
    for r in found:
        now = r.digest
        for s in r.path:
            now = sha(s.before, now, s.after)
        assert now == root
    assert made.records[0].count() == 19 + 3 and made.upper[0].count() == 1


def test_ranks(spark):
    rows = spark.range(5000).selectExpr("case when id % 3 = 0 then 'hot' else concat('g', id % 40) end as g", "id % 11 as a", "id")
    out = ranked(settle(rows), "g", [F.col("a")]).toPandas()
    for _, own in out.groupby("g"):
        own = own.sort_values("pos")
        assert own.pos.tolist() == list(range(len(own))) and own.a.is_monotonic_increasing and (own.n == len(own)).all()


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = got(queries.op13_merkle(spark, "/root/testdata/sf0.001"))
    assert out == brute([r.asDict() for r in docs.collect()])
    assert 0 < sum(not r[-1] for r in out) < len(out) / 3
