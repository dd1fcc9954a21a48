"""Hand-written cases: null handling, ties, globs, revisions, names and greedy kernels."""

import random

import pytest
from pyspark.sql import functions as F

from stockroom.functions.names import read_name
from stockroom.operators import files, findings, integrity, lineage, overlay, ranks, references, transfers, weights
from stockroom.plans.registry import cut


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {v}" for k, v in {k: {"str": "string", "int": "long", "bool": "boolean", "list": "array<string>", "NoneType": "string"}[type(v).__name__] for k, v in values.items()}.items()))
    return frame.select(column).first()[0]


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("*.txt", "a/b.txt", True),
        ("/*.txt", "a/b.txt", True),
        ("/b.txt", "a/b.txt", False),
        ("b.txt", "a/b.txt", True),
        ("a/*", "a/b/c", True),
        ("[*].txt", "*.txt", True),
        ("[*].txt", "x.txt", False),
        ("[!a].txt", "b.txt", True),
        ("A.txt", "a.txt", False),
        ("?.txt", "ab.txt", False),
    ],
)
def test_globs(spark, pattern, path, hit):
    assert one(spark, files.matches(F.col("path"), [pattern]), path=path) is hit


@pytest.mark.parametrize(
    ("want", "got", "fits"),
    [("a" * 12, "a" * 40, True), ("a" * 40, "a" * 12, True), ("a" * 11, "a" * 40, False), ("main", "main", True), ("main", "b" * 40, False), ("z" * 12, "z" * 12, True), ("z" * 12, "z" * 13, False)],
)
def test_revisions(spark, want, got, fits):
    assert one(spark, overlay.revision_fits(F.col("want"), F.col("got"), F.lit("other")), want=want, got=got) is fits


def test_include_key_ignores_order_and_star(spark):
    key = lambda x: one(spark, overlay.include_key(F.col("x")), x=x)
    assert key(["b", "a", "b"]) == ["a", "b"] and key(["/*"]) == []


NAMES = [
    ("Qwen3.8-2.4T-A95B", "Qwen", "3.8", "2.4T-A95B", [], [], 2.4e12, 95e9),
    ("qwen3.8-max-0902", "qwen", "3.8", "max-0902", [], [], None, None),
    ("Qwen3-8B-Base", "Qwen", "3", "8B", ["base"], [], 8e9, None),
    ("Qwen3-Coder-480B-A35B-Instruct", "Qwen", "3", "Coder-480B-A35B", ["instruct"], [], 480e9, 35e9),
    ("Kimi-K2.5", "Kimi", "K2.5", None, [], [], None, None),
    ("Kimi-K3-Abliterated-V1", "Kimi", "K3", "V1", ["abliterated"], [], None, None),
    ("DeepSeek-Coder-V2-Instruct", "DeepSeek-Coder", "V2", None, ["instruct"], [], None, None),
    ("DeepSeek-R1-Distill-Qwen-32B", "DeepSeek", "R1", "Qwen-32B", ["distill"], [], 32e9, None),
    ("GLM-4.5V", "GLM", "4.5", "V", [], [], None, None),
    ("Meta-Llama-3.1-8B-Instruct-abliterated", "Meta-Llama", "3.1", "8B", ["instruct", "abliterated"], [], 8e9, None),
    ("gemma-3-27b-pt", "gemma", "3", "27b", ["base"], [], 27e9, None),
    ("Mistral-Small-3.2-24B-Instruct-2506", "Mistral-Small", "3.2", "24B-2506", ["instruct"], [], 24e9, None),
    ("Mixtral-8x7B-Instruct-v0.1", "Mixtral", None, "8x7B-v0.1", ["instruct"], [], 56e9, 7e9),
    ("esm3-sm-open-v1", "esm", "3", "sm-open-v1", [], [], None, None),
    ("tiny-gpt2", "tiny-gpt", "2", None, [], [], None, None),
    ("bert-base-uncased", "bert", None, "base-uncased", [], [], None, None),
    ("bge-base-en-v1.5", "bge", None, "base-en-v1.5", [], [], None, None),
    ("Qwen3-32B-i1-GGUF", "Qwen", "3", "32B", [], ["imatrix", "gguf"], 32e9, None),
    ("", None, None, None, [], [], None, None),
    (None, None, None, None, [], [], None, None),
]


@pytest.mark.parametrize("case", NAMES, ids=lambda c: str(c[0]))
def test_names(case):
    assert tuple(read_name(case[0]).values()) == case[1:]


def greedy(sizes, n):
    """Lanes of files in order, by the rule itself."""
    load, out = [[0, 0, k] for k in range(n)], []
    for size in sizes:
        lightest = min(load)
        lightest[0] += size
        lightest[1] += 1
        out.append(lightest[2])
    return out


def test_lanes_are_greedy(spark):
    rows = spark.createDataFrame([("a", f"p{k}", s) for k, s in enumerate([5, 4, 3, 3, None])], "aid string, path string, size long")
    got = {r["path"]: r["lane"] for r in transfers.lanes(rows, 2, cut).collect()}
    assert got == {"p0": 0, "p1": 1, "p2": 1, "p3": 0, "p4": 1}


@pytest.mark.parametrize("seed", range(60))
def test_lane_runs_equal_the_rule(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 6)
    sizes = sorted(((rng.choice([0, 1, 2, 3, 7, 50, 400]), rng.randint(1, 40)) for _ in range(rng.randint(1, 6))), reverse=True)
    sizes = [(s, sum(m for t, m in sizes if t == s)) for s in dict.fromkeys(s for s, _ in sizes)]
    want, at = greedy([s for s, m in sizes for _ in range(m)], n), 0
    got = []
    for _, _, took, turn in transfers.lane_runs(sizes, n):
        got += [turn[k % len(turn)] for k in range(took)]
        at += took
    assert got == want


def test_budget_skips_but_goes_on(spark):
    rows = spark.createDataFrame([("t", "a", 50, 0), ("t", "b", 60, 1), ("t", "c", 40, 2), ("t", "d", 500, 0), ("t", "e", None, 3)], "aid string, path string, size long, priority int")
    got = {r["path"]: r["outcome"] for r in transfers.scan_budget(rows, 100, 100).collect()}
    assert got == {"a": "read", "b": "over budget", "c": "read", "d": "oversize", "e": "read"}
    got = {r["path"]: r["outcome"] for r in transfers.scan_budget(rows, 100, 100, 2).collect()}
    assert got == {"a": "read", "b": "over budget", "c": "read", "d": "oversize", "e": "over budget"}
    assert transfers.scan_budget(rows.limit(0), 100, 100).count() == 0


def test_running_sums_over_parts(spark):
    rows = spark.range(500).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"), F.lit(2).alias("v")).repartition(7)
    out = ranks.running(rows, ["g"], ["o"], cut, "v").collect()
    assert all(r["rank"] == r["o"] // 2 + 1 and r["upto"] == 2 * r["rank"] for r in out) and len(out) == 500


def test_shard_groups_and_unknown_sizes(spark):
    rows = spark.createDataFrame([("a", "m-00001-of-00002.gguf", 1), ("a", "m-00002-of-00002.gguf", None), ("a", "n-00001-of-00002.gguf", 4), ("a", "mmproj-x.gguf", 2)], "aid string, path string, size long")
    got = {r["variant"]: (r["complete"], r["bytes"], r["projector"]) for r in weights.gguf_groups(rows).collect()}
    assert got == {"m": (True, None, False), "n": (False, 4, False), "mmproj-x.gguf": (True, 2, True)}


def test_three_valued_imatrix(spark):
    variants = spark.createDataFrame([("a", "x", ["1", "2"]), ("a", "y", ["3"]), ("a", "z", ["4", "5"])], "aid string, variant string, paths array<string>")
    headers = spark.createDataFrame([("a", "1", False), ("a", "2", True), ("a", "3", False), ("a", "4", False)], "aid string, path string, imatrix boolean")
    assert {r["variant"]: r["imatrix"] for r in weights.imatrix_marks(variants, headers).collect()} == {"x": True, "y": False, "z": None}


def test_docstrings_and_stages(spark):
    texts = spark.createDataFrame(
        [
            ("t", "a.py", 'X = "own/net-1"\n"""\n"own/net-2"\n"""\nY = "own/net-3"'),
            ("t", "Dockerfile", "FROM own/base:1 AS build\nFROM build\nFROM scratch\nFROM own/run:2"),
            ("t", ".env", "M=${A:-${B:-own/net-4}}\nexport K='own/net-5'"),
            ("t", "skip.bin", "own/net-9"),
        ],
        "tree string, path string, text string",
    )
    found = {(r["ref"], r["tier"]) for r in references.folded(references.hits(texts)).collect()}
    assert {("own/net-1", "evidence"), ("own/net-3", "evidence"), ("own/base:1", "declared"), ("own/run:2", "declared"), ("own/net-4", "evidence"), ("own/net-5", "declared")} <= found
    assert ("own/net-2", "mentioned") in found  # inside a docstring
    assert not {r for r, _ in found} & {"own/net-9", "build", "scratch"}


def test_front_matter(spark):
    text = "---\ntitle: x\nmodels:\n  - own/a\n  - 'own/b'\ndatasets: [own/c, own/d]\ntags:\n  - own/no\n---\nmodels:\n- own/late"
    rows = spark.createDataFrame([("t", "README.md", text), ("t", "x/README.md", "models:\n- own/z")], "tree string, path string, text string")
    found = references.front_matter(references.prose_marks(references.lines_of(rows))).collect()
    assert {r["ref"] for r in found} == {"own/a", "own/b", "datasets/own/c", "datasets/own/d"}


def test_git_blob_and_upstream(spark):
    frame = spark.createDataFrame([(bytearray(b"hello\n"),)], "content binary")
    assert frame.select(integrity.git_blob_id(F.col("content"))).first()[0] == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert one(spark, integrity.upstream_verdict(F.lit("a"), F.lit(None), F.lit("b"), F.lit(None)), x="") is None


def test_ancestors_end_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    got = {(r["child"], r["ancestor"]): r["depth"] for r in lineage.ancestors(edges, cut).collect()}
    assert got[("a", "c")] == 2 and ("a", "a") not in got


def test_ancestors_at_any_depth(spark):
    edges = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(40)], "child string, parent string")
    got = lineage.ancestors(edges, cut).where("child = 'w0'")
    assert got.count() == 40 and got.agg(F.max("depth")).first()[0] == 40
    assert lineage.ancestors(edges.limit(0), cut).count() == 0


@pytest.mark.parametrize(
    ("path", "line", "refs"),
    [
        ("a.py", "x = 'own/net'", {"own/net"}),
        ("a.py", "a = input/output", set()),
        ("a.py", "x = own/net-2", {"own/net-2"}),
        ("a.md", "bf16/fp32 and NVFP4/FP8", set()),
        ("a.md", "see Own/net-2, not own/net-3.", {"Own/net-2"}),
        ("a.py", "open('src/net-2'), 'own/net.json', '12/34'", set()),
        ("a.py", "docker run team/img:v1@sha256:" + "0" * 64, {"team/img:v1@sha256:" + "0" * 64}),
        ("a.md", "https://github.com/sponsors/x https://github.com/own/r.git", {"own/r"}),
        ("a.md", "https://hf.co/own/m, https://huggingface.co/datasets/own/d.", {"own/m", "datasets/own/d"}),
        ("a.py", "user@own/net-1 ./own/net-1 $own/net-1", set()),
        ("b.sql", "-- Own/net-9 or own/net9", {"Own/net-9"}),
        (".github/x.png", "own/net-1", set()),
        ("a.md", "Run team/img:v1. Then team/img:v2, (team/img:v3)", {"team/img:v1", "team/img:v2", "team/img:v3"}),
        ("a.py", "f(reg.io:5000/a/b:1) x/y:1/z:2 Team/img:v1 a:1", {"reg.io:5000/a/b:1"}),
        ("a.py", "${A:-own/a-1} ${B:-x ${C:-img:2} } ${D:-https://hf.co/own/m?$x} ${E:-${F}}", {"own/a-1", "img:2", "own/m"}),
        ("a.md", "https://hf.co/own./m.:https://hf.co/datasets/d https://hf.co/own https://hf.com/a/b", {"own/m", "datasets/d"}),
        ("a.py", '"own/net" \'own/word" `own/kept`', {"own/net", "own/kept"}),
        ("Dockerfile", "FROM img@sha256:" + "0" * 64, {"img@sha256:" + "0" * 64}),
        ("compose.yaml", "  image: host:5000/img", set()),
        (".env", "M='https://huggingface.co/own/m/tree/main'", {"own/m"}),
    ],
)
def test_lines(spark, path, line, refs):
    rows = spark.createDataFrame([("t", path, line)], "tree string, path string, text string")
    assert {r["ref"] for r in references.hits(rows).collect()} == refs


def test_finding_ids_and_redaction(spark):
    assert one(spark, findings.finding_id(F.col("c"), F.col("p"), F.lit(None)), c="q", p="x").startswith("q:")
    assert one(spark, findings.redacted(F.col("t")), t="api_key: abc, b") == "api_key: [redacted], b"


def test_digest_of_a_hot_artifact_is_folded_over_batches(spark):
    import hashlib

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        rows = spark.range(200).select(F.when(F.col("id") < 150, "hot").when(F.col("id") < 190, F.concat(F.lit("a"), F.col("id") % 13)).alias("aid"), F.concat(F.lit("p"), F.col("id") * 37 % 200).alias("path"), F.when(F.col("id") % 11 > 0, F.sha2(F.col("id").cast("string"), 256)).alias("sha256"), F.col("id").alias("size"))
        got = {r["aid"]: r["artifact_sha256"] for r in integrity.artifact_hash(rows.repartition(5)).collect()}
        signed = {r["aid"]: r["signature"] for r in transfers.scope_signature(rows.repartition(5)).collect()}
    finally:
        spark.conf.set(key, before)
    want, sizes = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["path"]):
        want.setdefault(r["aid"], []).extend([f"{r['sha256']}  {r['path']}"] if r["sha256"] else [])
        sizes.setdefault(r["aid"], []).append(f"{r['path']}\t{r['size']}")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {a: sha("\n".join(lines) + "\n") for a, lines in want.items()}
    assert signed == {a: sha("\n".join(sorted(lines))) for a, lines in sizes.items()}
    assert integrity.artifact_hash(rows.limit(0)).count() == 0


def test_lanes_of_unknown_sizes_take_few_turns():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randrange(1, 6)
        sizes = sorted(((rng.choice([0, 0, 1, 2, 5, 9]), rng.randrange(1, 40)) for _ in range(rng.randrange(1, 4))), reverse=True)
        sizes = list(dict(sizes).items())
        load, want = [[0, 0, k] for k in range(n)], []
        for size, files_ in sizes:
            for _ in range(files_):
                x = min(load)
                want.append((size, x[2]))
                x[0], x[1] = x[0] + size, x[1] + 1
        runs = list(transfers.lane_runs(sizes, n))
        assert [(size, turn[i % len(turn)]) for size, _, took, turn in runs for i in range(took)] == want
    assert len(list(transfers.lane_runs([(7, 10), (0, 10_000_000)], 8))) < 100


def exchanges(frame) -> int:
    """Shuffles that a plan asks for before it runs."""
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_classification_stays_by_artifact(spark, small):
    """Files are dealt by artifact once; no join, group or window behind that deals whole sets or files again."""
    from stockroom.operators import classify
    from stockroom.plans import classification

    _, sets = classify.classified(**classification.facts(spark, small))
    assert exchanges(sets) < 13  # 15 before


def test_keep_lists_order_files_once(spark, small):
    """No file is stored on the way, and an artifact's files are ordered for numbers, sets, twins and names, not for each join."""
    from stockroom.plans import classification

    frame = classification.k12(spark, small)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "cut-" not in plan and exchanges(frame) <= 3
    assert plan.count("Join") <= 2  # 9 before, and those of the classification in the run that stored the files


def test_parts_grow_with_the_rows(spark):
    from stockroom.operators import ranks

    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ranks.parts(spark.range(10), 5) == few and ranks.parts(spark.range(1000), 10) == 101
    assert ranks.by_size(spark.range(1000), "id", each=10).rdd.getNumPartitions() == 101
