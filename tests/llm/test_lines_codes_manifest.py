import hashlib
import random
import re
import string
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import codebooks, lines, manifest

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def oracle(sql):
    c = duckdb.connect()
    for name in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return sorted(map(str, c.sql(sql).fetchall()))


@pytest.mark.parametrize("module, columns", [(lines, "doc_id n_lines n_dropped kept_sha256"), (codebooks, "vec_id code error label_error codebooks_sha256"), (manifest, "doc_id leaf subroot root proof_sha256 folded_root verified")])
def test_queries_agree_with_sql(spark, module, columns):
    columns = columns.split()
    got = module.query(spark, SF).select(*columns).collect()
    assert sorted(str(tuple(r)) for r in got) == oracle(f"SELECT {', '.join(columns)} FROM ({module.SQL})")


# --- Line dedup ---


def key_of(line):
    return line.strip(BLANK).translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def lines_by_definition(rows, least, documents):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= least:
                holders[key_of(line)].add(i)
    smaller = lambda i: -1 if i is None else i
    owner = {k: max(v, key=smaller) for k, v in holders.items() if len(v) >= documents}
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if key_of(x) not in owner or owner[key_of(x)] == i]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def lines_found(spark, df, **more):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in lines.without_repeated_lines(spark, df, **more).collect()), key=str)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_lines_agree_with_the_definition(spark, batches):
    draw = random.Random(5)
    pool = ["é" * 8, "Ünï  Code 12", "\x1f not blank \x1f", "  Padded line here\t", "padded line HERE", "padded line here\r", "short", "", "   ", "exactly8", "字" * 7, "字" * 8, "  kept blank  ", "padded\x0bline here"]
    rows = [(draw.choice([*range(60), None]), "\n".join(draw.choice(pool) for _ in range(draw.randrange(6)))) for _ in range(150)] + [(70, None), (71, ""), (72, "\n\n"), (73, "padded line here\n" * 40_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert lines_found(spark, df, least=8, documents=4, batches=batches) == lines_by_definition(rows, 8, 4)


def test_lines_of_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert lines_found(spark, odd) == lines_by_definition(rows, 40, 5)
    assert lines_found(spark, none) == []
    rest = lines.without_repeated_lines(spark, odd).where("doc_id = 1").first().rest
    assert rest.asDict() == {"score": 0.5, "rest": "r", "size": 1, "n_words": 2, "spans": [3], "key": True}


def test_settled_lines_enter_no_further_run(spark):
    runs = lines.LineRuns(spark, 4, documents=3)
    held = lambda ids, key: spark.createDataFrame([(i, bytearray(key)) for i in ids], "doc_id bigint, key binary")
    runs.add(held(range(90, 95), b"a" * 16).union(held([91], b"b" * 16)))
    runs.add(held(range(50, 60), b"a" * 16).union(held([50, 51], b"b" * 16)))
    runs.add(held(range(10), b"a" * 16).union(held([1], b"b" * 16)))
    assert [level is not None for level in runs.levels] == [True, True]
    assert spark.table(runs.levels[0]).count() == 0  # both keys are settled
    found = {bytes(r.key): (r.docs, r.owner) for r in runs.settled().collect()}
    assert found == {b"a" * 16: (5, 94), b"b" * 16: (3, 91)}
    runs.forget()


def test_runs_are_joined_without_moving_them(spark):
    runs = lines.LineRuns(spark, 4)
    held = spark.range(1000).select(F.col("id").alias("doc_id"), F.unhex(F.md5(F.col("id").cast("string"))).alias("key"))
    for k in range(3):
        runs.add(held.where(F.col("doc_id") % 3 == k))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = runs.unsettled(held.repartition(4, "key"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and plan.count("SortMergeJoin") == 2
    runs.forget()


# --- Vector codes ---


def codes_by_definition(rows, entries, rounds):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = -(-len(kept[0][1]) // 4)
    padded = [(i, v + [0] * (4 * w - len(v)), label) for i, v, label in kept]
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in padded[:entries]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    at = lambda y, book: min(range(len(book)), key=lambda e: (far(y, book[e]), e))
    for _ in range(rounds):
        for p in range(4):
            own = defaultdict(list)
            for _, v, _ in padded:
                own[at(part(v, p), books[p])].append(part(v, p))
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if own[e] else book for e, book in enumerate(books[p])]
    out = []
    for i, v, label in padded:
        code = [at(part(v, p), books[p]) for p in range(4)]
        out.append((i, label, "".join(f"{c:02x}" for c in code), sum(far(part(v, p), books[p][c]) for p, c in enumerate(code))))
    errors = defaultdict(int)
    for _, label, _, e in out:
        errors[label] += e
    size = len(kept[0][1])
    numbers = [str(x) for p in range(4) for entry in books[p] for x in entry[: max(0, size - p * w)]]
    return sorted(((i, c, e, errors[label]) for i, label, c, e in out), key=str), hashlib.sha256(",".join(numbers).encode()).hexdigest()


def codes_found(spark, rows, entries, rounds):
    df = spark.createDataFrame([(i, v if v is None else [x if x is None else float(x) for x in v], label) for i, v, label in rows], "vec_id bigint, embedding array<double>, label int")
    coded, _, digest = codebooks.compressed(spark, df, entries, rounds)
    return sorted(((r.rest.vec_id, r.code, r.error, r.label_error) for r in codebooks.with_label_errors(coded).collect()), key=str), digest


@pytest.mark.parametrize("size", [8, 10, 3])
def test_codes_agree_with_the_definition(spark, size):
    draw = random.Random(size)
    rows = [(draw.randrange(1_000), [draw.choice([draw.gauss(0, 1), 0.5, -0.25]) for _ in range(size)], draw.choice([1, 2, None])) for _ in range(300)]
    rows += rows[:5] + [(7, [0.0] * size, 1), (8, None, 1), (9, [float("nan")] * size, 2), (10, [None] + [1.0] * (size - 1), 2), (11, [float("-inf")] + [1.0] * (size - 1), 2), (None, [1e3] * size, None)]
    assert codes_found(spark, rows, 16, 3) == codes_by_definition(rows, 16, 3)


def test_codes_of_few_vectors_ties_and_other_sizes(spark):
    rows = [(3, [1.0, 1, 1, 1], 1), (1, [1.0, 1, 1, 1], 1), (2, [-1.0, 0, 0, 0], None)]
    assert codes_found(spark, rows, 256, 4) == codes_by_definition(rows, 256, 4)
    found, _ = codes_found(spark, [*rows, (4, [1.0], 1), (5, [1e300, 0, 0, 0], 1)], 256, 4)
    assert [r[1:3] for r in found if r[0] in (4, 5)] == [(None, None)] * 2
    assert codes_found(spark, [], 256, 4) == ([], hashlib.sha256(b"").hexdigest())
    assert codes_found(spark, [(1, None, 1)], 256, 4)[0] == []


def test_distances_are_exact_at_the_largest_components():
    most = codebooks.largest(4 * 4)
    x = np.full((1, 4, 4), most, np.int64)
    index, distance = codebooks.nearest(x, [np.full((1, 4), -most, np.int64)] * 4)
    assert int(distance.sum()) == 16 * (2 * most) ** 2 < 2**63


def test_compressed_keeps_further_columns(spark):
    df = spark.createDataFrame([(1, [0.5] * 4, 1, "x", "y")], "vec_id bigint, embedding array<float>, label int, code string, vector string")
    assert codebooks.compressed(spark, df)[0].first().rest.asDict() == {"vec_id": 1, "label": 1, "code": "x", "vector": "y"}


# --- Merkle manifest ---


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest_by_definition(rows, tampered):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(field, r))

    def tree(nodes):
        """The root, and of each node the siblings by level: (before, behind)."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, k in enumerate(at):
                lo = k // 3 * 3
                ways[i].append((nodes[lo:k], nodes[k + 1 : lo + 3]))
                at[i] = k // 3
            nodes = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        return nodes[0], ways

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    out, tops = [], []
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, ways = tree([leaf(r) for r in own])
        tops.append(top)
        out += [(len(tops) - 1, r, way) for r, way in zip(own, ways, strict=True)]
    root, above = tree(tops)
    found = []
    for s, r, way in out:
        way = way + above[s]
        node = leaf((*r[:4], tampered(r)))
        for a, b in way:
            node = h(*a, node, *b)
        found.append((r[0], leaf(r), tops[s], root, h(*[x for a, b in way for x in a + b]), node, node == root))
    return sorted(found, key=str)


def broken(r):
    return r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]


@pytest.mark.parametrize("depth", [1, 2, 8])
def test_manifest_agrees_with_the_definition(spark, depth):
    draw = random.Random(depth)
    names = ["a", "b", "é", "z", "", "Z", "字", None, *[f"s{k}" for k in range(14)]]
    rows = [(draw.choice([None, draw.randrange(10**6)]), draw.choice(["a", "a", "a", *names]), draw.choice(["en", None]), draw.choice([None, 5, -7]), draw.choice([None, "", "x\ny\n", "é\n" * 9, "one"])) for _ in range(200)]
    rows += rows[:4] + [(5, "long", "en", 1, "word \n" * 100_000), (6, "lone", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    got = manifest.manifest(df, manifest.without_breaks(), depth).drop("rest")
    assert sorted((tuple(r) for r in got.collect()), key=str) == manifest_by_definition(rows, broken)


def test_manifest_of_one_row_further_columns_and_none(spark, none):
    df = spark.createDataFrame([(1, "s", None, 3, "a\nb", "g", 1)], "doc_id bigint, source string, lang string, n_chars bigint, text string, grp string, pos int")
    row = manifest.manifest(df).first()
    assert row.root == row.folded_root == row.subroot == row.leaf == h("1:1", "1:s", "-", "1:3", "3:a\nb")
    assert row.verified and row.proof_sha256 == h() and (row.rest.grp, row.rest.pos) == ("g", 1)
    assert manifest.manifest(none).collect() == []
    with pytest.raises(ValueError, match="lang"):
        manifest.manifest(df.drop("lang"))


def test_any_other_change_is_found(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    changed = F.when(F.col("doc_id") == 17, F.lit("text 18")).otherwise(F.col("text"))
    assert [r.doc_id for r in manifest.manifest(df, changed, 2).where("not verified").collect()] == [17]
    assert re.fullmatch("[0-9a-f]{64}", manifest.manifest(df, changed, 2).first().root)
