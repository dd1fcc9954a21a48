"""Rule tables, classification, configuration facts and sources on small hand-written frames."""

import datetime as dt
import hashlib
import json
import struct
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stockroom.operators import classify, enrich, overlay, references, rules
from stockroom.sources import headers, scans

RULES = "artifact_type string, label string, glob string, required boolean, ordinal int"


def test_completeness_keeps_unmatched_labels(spark):
    table = spark.createDataFrame([("model", "weights", "*.safetensors", True, 0), ("model", "weights", "*.gguf", True, 0), ("model", "card", "/README.md", True, 1), ("model", "tests", "tests/*", False, 2)], RULES)
    files = spark.createDataFrame([("a", "model", "x.gguf"), ("a", "model", "README.md"), ("b", "model", "deep/README.md"), ("c", "music", "x")], "aid string, artifact_type string, path string")
    got = {(r["aid"], r["label"]): (r["present"], r["status"]) for r in rules.completeness(files, table).collect()}
    assert got[("a", "weights")] == (True, "complete") and got[("a", "tests")] == (False, "complete")
    assert got[("b", "weights")] == (False, "incomplete") and got[("c", None)][1] == "unknown"


def test_engines_and_declarations(spark):
    table = spark.createDataFrame([("m", "e1", "config.json", True, 1), ("m", "e1", "*.safetensors", False, 1), ("m", "e1", "*.bin", False, 1), ("m", "e0", "*.gguf", True, 0)], RULES)
    files = spark.createDataFrame([("a", "m", "config.json"), ("a", "m", "w.bin"), ("a", "m", "x.gguf"), ("b", "m", "config.json")], "aid string, artifact_type string, path string")
    assert {r["aid"]: r["engines"] for r in rules.engines(files, table).collect()} == {"a": ["e0", "e1"]}
    assert {(r["aid"], r["label"]): r["files"] for r in rules.declarations(files, table).collect()} == {("a", "e1"): 2, ("a", "e0"): 1, ("b", "e1"): 1}


def test_attributes_are_scoped(spark):
    files = spark.createDataFrame([("a", p) for p in ("x.bin", "d/x.bin", "d/e/x.bin", "e/y.dat")], "aid string, path string")
    lines = spark.createDataFrame([("a", "d", "*.bin"), ("a", "", "e/*.dat")], "aid string, dir string, pattern string")
    assert {r["path"] for r in rules.lfs_routed(files, lines).collect()} == {"d/x.bin", "d/e/x.bin", "e/y.dat"}


def test_weights_choice(spark):
    groups = spark.createDataFrame([("a", "x", True, False), ("a", "p", True, True), ("b", "x", True, False), ("b", "y", True, False), ("c", "x", False, False)], "aid string, variant string, complete boolean, projector boolean")
    assert {r["aid"]: (r["outcome"], r["chosen"]) for r in rules.weights_choice(groups).collect()} == {"a": ("chosen", "x"), "b": ("ambiguous", None), "c": ("refused", None)}


def test_runnable_bands(spark):
    models = spark.createDataFrame([("a", 100), ("b", None)], "aid string, need long")
    machines = spark.createDataFrame([("s", 99), ("m", 120), ("l", 130)], "machine string, ram_bytes long")
    got = {(r["aid"], r["machine"]): r["verdict"] for r in rules.runnable(models, machines).collect()}
    assert [got[("a", m)] for m in "sml"] == ["error", "warning", "ok"] and got[("b", "s")] == "unknown"


EVIDENCE = "aid string, kind string, set string, format string, first_path string, digests array<string>, bytes long, base_identical boolean, config_unreadable boolean, dtype string, quant_method string, complete boolean, header_read boolean, headers_disagree boolean, imatrix boolean, foreign_source boolean"


def evidence(aid, kind, name, digest, **more):
    row = dict(base_identical=None, config_unreadable=None, dtype=None, quant_method=None, complete=None, header_read=None, headers_disagree=None, imatrix=None, foreign_source=None) | more
    form = kind if kind in ("gguf", "legacy", "support") else "safetensors"
    return (aid, kind, name, form, f"{name}/f", [digest], 1, *row.values())


def test_rule_cascade(spark):
    bf = {"dtype": "BF16", "complete": True}
    read = {"complete": True, "header_read": True}
    rows = [
        evidence("a", "support", "", "s"),
        evidence("a", "indexed", "i", "1", **bf),
        evidence("a", "standalone", "copy/of", "1", **bf),
        evidence("a", "gguf", "g", "2", **read),
        evidence("a", "gguf", "im", "3", imatrix=True, **read),
        evidence("a", "gguf", "no", "4", complete=True, header_read=False),
        evidence("a", "gguf", "same", "2", **read),
        evidence("b", "gguf", "g", "1", **read),
        evidence("b", "gguf", "cut", "5", complete=False, header_read=True),
        evidence("b", "gguf", "odd", "6", headers_disagree=True, **read),
        evidence("c", "standalone", "s", "1", **bf),
        evidence("c", "standalone", "t", "2", **bf),
        evidence("c", "gguf", "g", "3", **read),
        evidence("c", "gguf", "f", "4", foreign_source=True, **read),
        evidence("c", "legacy", "l", "5"),
        evidence("d", "indexed", "q", "1", quant_method="awq"),
        evidence("d", "indexed", "n", "2", complete=True),
        evidence("d", "orphan", "o", "3", **bf),
        evidence("d", "indexed", "base", "4", base_identical=True, **bf),
        evidence("d", "standalone", "c", "6", config_unreadable=True, quant_method="awq"),
        evidence("d", "index_error", "e", "7", **bf),
        evidence("d", "standalone", "i8", "8", dtype="I8"),
        evidence("d", "gguf", "base", "9", base_identical=True, **read),
        evidence("e", "legacy", "l", "1"),
        evidence("e", "gguf", "g", "2", **read),
        evidence("f", "orphan", "o", "1", **bf),
        evidence("f", "gguf", "g", "2", **read),
    ]
    sets = classify.judged(classify.with_twins(spark.createDataFrame(rows, EVIDENCE))).collect()
    got = {(r["aid"], r["set"], r["kind"]): (r["rule"], r["verdict"]) for r in sets}
    assert got == {
        ("a", "", "support"): ("R1", "support"), ("a", "i", "indexed"): ("R3", "negative"), ("a", "copy/of", "standalone"): ("R15", "print"), ("a", "g", "gguf"): ("R9", "unknown"), ("a", "im", "gguf"): ("R7", "negative"), ("a", "no", "gguf"): ("R14", "unknown"), ("a", "same", "gguf"): ("R9", "unknown"),
        ("b", "g", "gguf"): ("R10", "negative"), ("b", "cut", "gguf"): ("R14", "unknown"), ("b", "odd", "gguf"): ("R14", "unknown"),
        ("c", "s", "standalone"): ("R4", "negative"), ("c", "t", "standalone"): ("R4", "negative"), ("c", "g", "gguf"): ("R11", "unknown"), ("c", "f", "gguf"): ("R8", "unknown"), ("c", "l", "legacy"): ("R12", "unknown"),
        ("d", "q", "indexed"): ("R5", "negative"), ("d", "n", "indexed"): ("R14", "unknown"), ("d", "o", "orphan"): ("R6", "unknown"), ("d", "base", "indexed"): ("R2", "print"), ("d", "c", "standalone"): ("R14", "unknown"), ("d", "e", "index_error"): ("R14", "unknown"), ("d", "i8", "standalone"): ("R5", "negative"), ("d", "base", "gguf"): ("R11", "unknown"),
        ("e", "l", "legacy"): ("R13", "negative"), ("e", "g", "gguf"): ("R9", "unknown"),
        ("f", "o", "orphan"): ("R6", "unknown"), ("f", "g", "gguf"): ("R9", "unknown"),
    }
    totals = {r["aid"]: r for r in classify.verdict_totals(classify.judged(classify.with_twins(spark.createDataFrame(rows, EVIDENCE)))).collect()}
    assert totals["a"]["skipped_bytes"] == 1 and totals["a"]["kept_bytes"] == 6


def test_twins_at_the_root_and_by_folder(spark):
    rows = [evidence("a", "standalone", name, "1", dtype="BF16") for name in ("a-b", "a", "z/y")]
    got = {r["set"]: r["twin_of"] for r in classify.with_twins(spark.createDataFrame(rows, EVIDENCE)).collect()}
    assert got == {"a": None, "a-b": "a", "z/y": "a"}


def test_sets_of_files(spark):
    files = spark.createDataFrame([("a", p) for p in ("m/w1.safetensors", "m/w2.safetensors", "x.safetensors", "old.bin", "q-00001-of-00002.gguf", "README.md", "e/w.safetensors", "m/p.bin")], "aid string, path string")
    text = json.dumps({"weight_map": {"t": "w1.safetensors", "u": "sub/w9.safetensors", "p": "p.bin"}})
    indexes = spark.createDataFrame([("a", "m/model.index.json", text), ("a", "e/model.index.json", "{cut")], "aid string, path string, text string")
    got = {r["path"]: (r["kind"], r["format"], r["set"]) for r in classify.file_sets(files, indexes).collect()}
    assert got["m/w1.safetensors"] == ("indexed", "safetensors", "m/model.index.json") and got["m/w2.safetensors"][0] == "orphan" and got["e/w.safetensors"][0] == "index_error"
    assert got["x.safetensors"][0] == "standalone"  # an index speaks of its own folder only
    assert got["m/p.bin"][:2] == ("indexed", "legacy")
    assert got["old.bin"][0] == "legacy" and got["q-00001-of-00002.gguf"][2] == "q" and got["README.md"][0] == "support"


def test_keep_lists(spark):
    w = lambda aid, path, skip=False, name=None, kind="standalone": (aid, path, kind, name or path, skip)
    rows = [
        w("a", "m-00001-of-00002.safetensors", name="m"), w("a", "m-00002-of-00002.safetensors", name="m"), w("a", "copy/x.safetensors", True), w("a", "notes.txt", kind="support", name=""), w("a", "README.md", kind="support", name=""),
        w("b", "x.safetensors"), w("b", "copy/x.safetensors", True),
        w("c", "p.bin", name="l", kind="legacy"), w("c", "q.bin", name="l", kind="legacy"), w("c", "copy/q.bin", True, kind="legacy"),
        w("d", "x.safetensors"), w("e", "x.safetensors", True), w("e", "README.md", kind="support", name=""),
        w("f", "odd[1].safetensors"), w("f", "copy/y.safetensors", True),
    ]
    got = {r["aid"]: (r["include"], r["explicit_paths"], r["note"]) for r in classify.keep_list(spark.createDataFrame(rows, "aid string, path string, kind string, set string, skip boolean")).collect()}
    assert got["a"] == (["/notes.txt", "m-*-of-00002.safetensors"], False, None)
    assert got["b"] == (["/x.safetensors"], False, None)  # unanchored, the name would fit the copy too
    assert got["c"] == (["/p.bin", "/q.bin"], True, None)
    assert got["d"] == (None, None, None) and got["e"] == (None, None, "nothing would be left")
    assert got["f"] == (["/odd[[]1].safetensors"], True, None)  # as a pattern, the name doesn't fit itself


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"num_hidden_layers": 4, "num_attention_heads": 8, "hidden_size": 64}', ("mha", 4, 0, 8, 8, 2)),
        ('{"num_hidden_layers": 4, "num_attention_heads": 8, "num_key_value_heads": 2, "head_dim": 16}', ("gqa", 4, 0, 2, 16, 2)),
        ('{"num_hidden_layers": 4, "num_attention_heads": 8, "num_key_value_heads": 1, "head_dim": 16}', ("mqa", 4, 0, 1, 16, 2)),
        ('{"num_hidden_layers": 4, "num_attention_heads": 8, "kv_lora_rank": 512, "qk_rope_head_dim": 64}', ("mla", 4, 0, 1, 576, 1)),
        ('{"num_hidden_layers": 3, "num_attention_heads": 2, "head_dim": 4, "sliding_window": 9, "layer_types": ["sliding_attention", "full_attention", "linear_attention"]}', ("mha", 1, 1, 2, 4, 2)),
        ('{"num_hidden_layers": 6, "num_attention_heads": 2, "head_dim": 4, "sliding_window": 9, "sliding_window_pattern": 6}', ("mha", 1, 5, 2, 4, 2)),
        ('{"hidden_size": 64}', None),
        ("not json", None),
    ],
)
def test_attention(spark, text, want):
    frame = spark.createDataFrame([(text,)], "t string").select(enrich.config(F.col("t")).alias("c"))
    shape = frame.select(enrich.attention_shape(F.col("c"))).first()[0]
    assert (shape and (shape["kind"], shape["full_layers"], shape["sliding_layers"], shape["kv_heads"], shape["head_dim"], shape["values"])) == want


def test_small_facts(spark):
    frame = spark.createDataFrame([(["license:mit", "GGUF"], "x-awq", {"F32": 3, "BF16": 5, "I8": 0}, "true")], "tags array<string>, name string, n map<string,long>, gated string")
    got = frame.select(enrich.license_of(F.col("tags")), enrich.format_labels(F.col("tags"), F.col("name")), enrich.parameters(F.col("n"), F.lit(None), F.lit(None)), enrich.access(F.col("gated"))).first()
    assert got[0] == "mit" and got[1] == ["gguf", "awq"] and tuple(got[2]) == (8, "BF16") and got[3] == "gated"
    rows = spark.createDataFrame([("a", "mit", True), ("b", "odd", None)], "aid string, license string, gated boolean")
    flags = spark.createDataFrame([("mit", True, True, "note")], "license string, commercial boolean, derivatives boolean, note string")
    out = {r["aid"]: (r["commercial"], r["notes"], r["needs_manual_review"]) for r in enrich.licensing(rows, flags).collect()}
    assert out == {"a": (True, "note access is gated", True), "b": (None, "", True)}


def test_dataset_infos_and_structure(spark):
    schema = "aid string, config string, split string, examples long"
    infos = spark.createDataFrame([("a", "x", "train", 5)], schema)
    card = spark.createDataFrame([("a", "x", "test", 9), ("a", "y", "train", None)], schema)
    assert {r["config"]: (r["splits"], r["examples"]) for r in enrich.dataset_infos(infos, card).collect()} == {"x": (["train"], 5), "y": (["train"], None)}
    rows = spark.createDataFrame([(bytearray(b"PAR1..PAR1"), bytearray(b".PAR1"), "a.parquet", 10), (bytearray(b"{}\nx"), None, "a.jsonl", 4), (bytearray(b"x{"), None, "b.jsonl", 2), (bytearray(b""), None, "c.csv", 0), (bytearray(b"q"), None, "d.md", 1)], "head binary, tail binary, path string, size long")
    got = [r[0] for r in rows.select(enrich.structure(F.col("head"), F.col("tail"), F.col("path"), F.col("size"))).collect()]
    assert got == ["ok", "ok", "malformed", "empty", None]


def test_requests_against_transfers(spark):
    partials = spark.createDataFrame([("s", "r1", "main", "p1"), ("s", "r2", "main", "p2"), ("t", "r1", "main", "p3")], "source string, revision string, ref string, path string")
    asks = spark.createDataFrame([(1, "s", "main"), (2, "s", "r1"), (3, "u", None), (4, "t", None)], "request long, source string, revision string")
    assert {r["request"]: r["outcome"] for r in overlay.resumable(asks, partials).collect()} == {1: "ambiguous", 2: "resume", 3: "none", 4: "resume"}


def test_relocation(spark):
    rows = [("a", 1, dt.datetime(2024, 1, d), "x", h) for d, h in ((1, "Box.lan"), (2, "box"), (3, ""), (4, "other"))]
    rows = [(a, k, t, loc, h) for k, (a, _, t, loc, h) in enumerate(rows)]
    got = enrich.relocated(spark.createDataFrame(rows, "aid string, ordinal long, done timestamp, location string, host string"))
    assert sorted(r["ordinal"] for r in got.collect()) == [2, 3]


def test_sources_keep_unreadable_rows(spark):
    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    record = {"schema_version": "2.1.0", "bundle_id": "a", "artifact_type": "model", "source": {"canonical": "h:a/b", "revision": "r"}, "inventory": {"files": [{"path": "x", "size": 3, "sha256": "00"}]}}
    for name, text in (("a/1", json.dumps(record)), ("b/1", "{broken"), ("c/1", json.dumps(record | {"schema_version": "1.8.0"})), ("d/1", json.dumps(record | {"schema_version": "3.0.0"})), ("_trash/1", json.dumps(record))):
        (root / name).mkdir(parents=True)
        (root / name / "manifest.json").write_text(text)
    rows = scans.manifests(spark, str(root))
    assert sorted(r["standing"] for r in rows.collect()) == ["current", "migrate", "unreadable", "unsupported"]
    assert scans.inventory(rows).select("aid", "path", "size").collect() == [("a", "x", 3)]


def test_header_sources(spark):
    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    head = json.dumps({"__metadata__": {}, "t": {"dtype": "F16", "shape": [2, 3], "data_offsets": [0, 12]}}).encode()
    (root / "good.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + b"\0" * 12)
    (root / "cut.safetensors").write_bytes(struct.pack("<Q", 999) + head)
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    pairs = [text("general.name") + struct.pack("<I", 8) + text("own"), text("n") + struct.pack("<I", 4) + struct.pack("<I", 7), text("list") + struct.pack("<IIQ", 9, 5, 2) + struct.pack("<ii", 1, 2)]
    (root / "good.gguf").write_bytes(b"GGUF" + struct.pack("<IQQ", 3, 0, len(pairs)) + b"".join(pairs))
    (root / "bad.gguf").write_bytes(b"nope")
    got = headers.tensors(spark, str(root)).collect()
    assert [(r["tensor"], r["dtype"], r["shape"]) for r in got if r["error"] is None] == [("t", "F16", [2, 3])] and sum(r["error"] is not None for r in got) == 1
    got = headers.key_values(spark, str(root)).collect()
    assert {r["key"]: r["value"] for r in got if r["error"] is None} == {"general.name": "own", "n": "7", "list": "array(5, 2)"} and sum(r["error"] is not None for r in got) == 1


def test_records(spark):
    from stockroom.operators import records

    expected = spark.createDataFrame([("a", "p", 1), ("a", "q", 2), ("b", "p", 3)], "aid string, path string, size long")
    states = spark.createDataFrame([("a", "p", "verified", "1", True), ("a", "q", "verified", "2", None), ("b", "p", "partial", None, None)], "aid string, path string, status string, sha256 string, upstream_ok boolean")
    done, refused = records.completed_records(expected, states)
    assert {(r["path"], r["verified_against_upstream"]) for r in done.collect()} == {("p", True), ("q", None)} and [r["aid"] for r in refused.collect()] == ["b"]
    digest = records.estimate_digest(spark.createDataFrame([(1, 5, ["x", "", "x"])], "k long, total_bytes long, parents array<string>"), "k").first()["estimate"]
    assert digest["total_bytes"] == 5 and digest["parents"] == ["x"] and digest["license"] is None and tuple(digest.asDict()) == records.ESTIMATE
    identity = spark.createDataFrame([("a", "n", "f" * 40, "model", "h:o/n")], "aid string, bundle_name string, revision string, artifact_type string, canonical string")
    hashes = spark.createDataFrame([("a", "h")], "aid string, artifact_sha256 string")
    lineage_ = spark.createDataFrame([("a", "p", "merge", "card")], "child string, parent string, relation string, declared_by string")
    flags = spark.createDataFrame([("b", "mit")], "aid string, license string")
    state = spark.createDataFrame([("a", "complete")], "aid string, status string")
    row = records.bundle_records(identity, done, hashes, lineage_, flags, state).first()
    assert row["bundle_id"] == "n@" + "f" * 12 and row["inventory"]["total_bytes"] == 3 and row["licensing"] is None and row["validation"]["status"] == "complete" and row["parents"][0]["parent"] == "p"
    items = spark.createDataFrame([("t", "hub", "b", "declared", False), ("t", "hub", "a", "declared", True), ("t", "hub", "c", "declared", None), ("t", "image", "d", "mentioned", None)], "tree string, kind string, ref string, tier string, resolved boolean")
    assert [r["ref"] for r in items.orderBy(*records.reference_order()).collect()] == ["a", "c", "b", "d"]


def test_twins_alone_decide_on_what_is_kept(spark):
    """`skipped` says of each set what all the rules say, and its patterns are those of the classified files."""
    names = ("w.safetensors", "copy/w.safetensors", "copy/deep/w.safetensors", "x.safetensors", "p.bin", "q-00001-of-00002.gguf", "q-00002-of-00002.gguf", "copy/q-00001-of-00002.gguf", "notes.txt", "README.md")
    rows = [(a, name, 1, None if (a + i) % 11 == 0 else "s" + str((a >> i) % 2)) for a in range(64) for i, name in enumerate(names) if (a + 3 * i) % 7]
    files = spark.createDataFrame(rows, "aid long, path string, size long, sha256 string")
    indexes = spark.createDataFrame([(a, "model.safetensors.index.json", "{broken" if a % 3 else '{"weight_map": {"a": "w.safetensors", "b": "p.bin"}}') for a in range(0, 64, 2)], "aid long, path string, text string")
    configs = spark.createDataFrame([(a, "", '{"torch_dtype": "bfloat16"}') for a in range(0, 64, 3)], "aid long, dir string, text string")
    types = spark.createDataFrame([(1, "x.safetensors", "I8", 5), (1, "x.safetensors", "F16", 3), (1, "x.safetensors", "F16", 2), (2, "x.safetensors", "F32", 1)], "aid long, path string, dtype string, n long")
    entries = [(2, "q-00001-of-00002.gguf", "split.count", "2", None), (2, "q-00001-of-00002.gguf", "split.no", "1", None), (4, "q-00002-of-00002.gguf", None, None, "cut")]
    headers = spark.createDataFrame(entries, "aid long, path string, key string, value string, error string")
    base, locators = spark.createDataFrame([(8, "s0"), (8, "s1")], "aid long, sha256 string"), spark.createDataFrame([(a, f"own/m{a}") for a in range(64)], "aid long, locator string")
    classed, sets = classify.classified(files, indexes, configs, types, headers, base, locators)
    every = classify.skipped(files, indexes)
    got, want = (sorted((r["aid"], r["kind"], r["set"], r["files"], r["skip"]) for r in x.collect()) for x in (every, sets))
    assert got == want and sum(r[-1] for r in got) > 20
    one = every.select("aid", F.explode("paths").alias("path"), "kind", "set", "skip")
    assert sorted(one.collect()) == sorted(classed.select(*one.columns).collect())
    patterns, of_files = (sorted(map(str, x.collect())) for x in (classify.kept_patterns(every), classify.keep_list(classed.select("aid", "path", "kind", "set", "skip"))))
    assert patterns == of_files and sum("explicit_paths=True" in x for x in patterns) and sum("explicit_paths=False" in x for x in patterns)


def test_keep_lists_of_equal_names(spark):
    """A plain pattern fits a file of its name elsewhere only if it has no folder; each folder has its own groups."""
    w = lambda aid, path, skip=False: (aid, path, "standalone", path, skip)
    rows = [w("a", f"d{i}/m.bin") for i in range(300)] + [w("a", "e/n.bin", True), w("b", "m.bin"), w("b", "d/m.bin"), w("b", "d/n.bin", True), w("c", "d/m.bin"), w("c", "m.bin", True), w(None, "m.bin"), w("g", None)]
    got = {r["aid"]: (r["include"], r["explicit_paths"]) for r in classify.keep_list(spark.createDataFrame(rows, "aid string, path string, kind string, set string, skip boolean")).collect()}
    assert got["a"] == (sorted(f"d{i}/m.bin" for i in range(300)), False) and got["b"] == (["d/m.bin", "m.bin"], False) and got["c"] == (["d/m.bin"], False)
    assert got["g"] == (None, None) and got[None] == (None, None)


def test_every_shown_work_is_resolved(spark):
    """However many works a tree shows; what is mentioned, or no work, isn't asked for."""
    rows = [("t", "hub", f"own/m{i:02}", "declared" if i < 30 else "evidence") for i in range(60)] + [("t", "hub", "own/said", "mentioned"), ("t", "image", "own/m59", "declared"), ("u", "hub", "own/m01", "evidence"), ("u", "hub", "Own/M59", "evidence")]
    items = spark.createDataFrame(rows, "tree string, kind string, ref string, tier string")
    out = references.resolved(items, spark.createDataFrame([("own/M59",), ("own/said",), ("own/M01",), ("own/m01",)], "ref string"))
    got = {(r["tree"], r["kind"], r["ref"]): r["resolved"] for r in out.collect()}
    assert len(got) == len(rows) == out.count()
    assert sum(v is False for v in got.values()) == 58 and got[("t", "hub", "own/m01")] and got[("t", "hub", "own/m59")]
    assert got[("t", "hub", "own/said")] is None and got[("t", "image", "own/m59")] is None
    only = references.resolved(items, spark.createDataFrame([("own/m59",)], "ref string"))
    assert {r["tree"]: (r["primary"], r["reason"]) for r in references.primary(only).collect()} == {"t": ("own/m59", "one"), "u": ("Own/M59", "one")}


def test_ranged_sources_prune_the_listing_and_keep_failures(spark):
    from stockroom.sources import ranged

    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    for name, data in (("a/x.bin", b"one"), ("a/y.bin", b""), ("b/z.bin", b"three"), (".cache/n.bin", b"no")):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(data)
    rows = ranged.digests(spark, str(root), partitionBytes=1)
    assert rows.rdd.getNumPartitions() == 3
    want = {n: (hashlib.sha256(d).hexdigest(), hashlib.sha1(b"blob %d\0" % len(d) + d).hexdigest()) for n, d in (("a/x.bin", b"one"), ("a/y.bin", b""), ("b/z.bin", b"three"))}
    assert {r["path"]: (r["sha256"], r["git_sha1"]) for r in rows.collect()} == want
    few = rows.where(F.col("path").startswith("a/") & (F.col("size") > 0))
    assert few.rdd.getNumPartitions() == 1 and [r["path"] for r in few.collect()] == ["a/x.bin"]
    assert ranged.digests(spark, str(root / "b/z.bin")).first()["sha256"] == want["b/z.bin"][0]
    listed = spark.createDataFrame([("a/x.bin", 3), ("a/x.bin", 4), ("gone", 1)], "path string, size long")
    got = sorted((r["size"], r["sha256"], r["error"] is None) for r in ranged.listed_digests(listed, str(root)).collect() if r["size"] > 1)
    assert got == [(3, want["a/x.bin"][0], True), (4, None, False)]


def test_digest_of_a_file_over_two_gib(spark):
    from stockroom.sources import ranged

    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    size = (2 << 30) + 12_345
    with (root / "large.bin").open("wb") as f:  # sparse
        f.truncate(size)
    sha, zeros = hashlib.sha256(), bytes(1 << 20)
    for n in [1 << 20] * (size >> 20) + [size & (1 << 20) - 1]:
        sha.update(zeros[:n])
    row = ranged.digests(spark, str(root)).first()
    assert (row["size"], row["sha256"], row["error"]) == (size, sha.hexdigest(), None)


def test_key_values_seek_over_arrays_and_count_what_they_read():
    import io

    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    large = text("scores") + struct.pack("<IIQ", 9, 6, 50_000) + bytes(200_000)
    rest = text("n") + struct.pack("<II", 4, 7)
    file = b"GGUF" + struct.pack("<IQQ", 3, 0, 2) + large + rest
    assert list(headers.pairs(io.BytesIO(file), len(file), cap=200)) == [("scores", 9, "array(6, 50000)"), ("n", 4, "7")]
    with pytest.raises(ValueError, match="read cap"):
        list(headers.pairs(io.BytesIO(file), len(file), cap=60))
    with pytest.raises(ValueError, match="truncated"):
        list(headers.pairs(io.BytesIO(file[:5_000]), 5_000))
    with pytest.raises(ValueError, match="old version"):
        list(headers.pairs(io.BytesIO(b"GGUF" + struct.pack("<IQQ", 1, 0, 0)), 24))


def test_a_thousand_globs_fit_as_one_by_one(spark):
    import fnmatch
    import random

    from stockroom.operators import globs

    rng = random.Random(3)
    part = lambda: "".join(rng.choice("ab.") for _ in range(rng.randrange(1, 4)))
    shapes = ("{0}", "*{0}", "{0}*", "*", "{0}*{1}", "*{0}*", "?{0}", "[ab]{0}", "[!a]*", "**{0}")
    table = [(rng.choice("xy"), k, rng.choice(shapes).format(part(), part())) for k in range(1000)]
    paths = [(rng.choice("xyz"), "".join(rng.choice(["a", "b", ".", "a.b"]) for _ in range(rng.randrange(6)))) for _ in range(60)]
    rows, patterns = spark.createDataFrame(paths, "g string, path string").distinct(), spark.createDataFrame(table, "g string, k long, glob string")
    got = sorted((r["g"], r["path"], r["k"]) for r in globs.fitting(rows, patterns, ["g"], F.col("path")).collect())
    assert got == sorted((g, p, k) for g, p in set(paths) for h, k, glob in table if g == h and fnmatch.fnmatchcase(p, glob))
    assert globs.fitting(rows, patterns.limit(0), ["g"], F.col("path")).count() == 0


def test_tables_of_one_dialect(spark):
    heads = {"a,b\n1,2\n": True, "one\ntwo\n": True, 'a;"x;\n;y"\nb;c': True, "so, it is\nsaid, and, done": False, "a\tb\n\nc\td\n": True, "a,b\n1": False, 'q,"a ""b"", c"\nr,s\n': True}
    rows = spark.createDataFrame([(h, h.encode()) for h in heads], "t string, head binary")
    got = {r["t"]: r["v"] for r in rows.select("t", enrich.structure(F.col("head"), F.col("head"), F.lit("x.csv"), F.length("head")).alias("v")).collect()}
    assert {t: v == "ok" for t, v in got.items()} == heads
    cut = rows.where(F.col("t") == "a,b\n1").select(enrich.structure(F.col("head"), F.col("head"), F.lit("x.csv"), F.lit(1000)).alias("v"))
    assert cut.first()["v"] == "ok"  # the last line isn't whole


def test_revisions_meet_by_key(spark):
    long = [f"{k:040x}" for k in range(3, 6)]
    entries = spark.createDataFrame([(1, "s", None), (2, "s", long[0][:20]), (3, "s", "main"), (4, "s", "v1.0-release-x"), (5, "s", long[1] + "ff"), (6, "s", long[2].upper()), (7, "t", None)], "k long, source string, revision string").withColumn("include", F.lit(None).cast("array<string>"))
    holdings = spark.createDataFrame([("s", long[0], "main"), ("s", long[1], None), ("s", "v1.0-release-x", "v1.0-release-x")], "source string, revision string, ref string")
    holdings = holdings.withColumns({"include": F.lit(None).cast("array<string>"), "policy": F.lit(False), "part": F.lit(False), "archived": F.lit("2024"), "path": F.col("revision")})
    out = overlay.overlay(entries, holdings)
    assert {r["k"]: r["held_at"] for r in out.collect()} == {1: long[0], 2: long[0], 3: long[0], 4: "v1.0-release-x", 5: long[1], 6: None, 7: None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "e_meet" in plan and "h_meet" in plan


def test_shipped_licences_and_preflight(spark):
    from stockroom.functions import tables

    rows = spark.createDataFrame([("a", "mit", False, ["LICENSE"]), ("b", "odd", None, []), ("c", None, True, None), ("d", "llama2", True, ["x"])], "aid string, license string, gated boolean, license_files array<string>")
    got = {r["aid"]: r for r in enrich.licence_records(rows, tables.licences(spark)).collect()}
    assert got["a"]["attribution_required"] and got["a"]["patent_grant"] is False and got["a"]["notes"] == [] and not got["a"]["needs_manual_review"]
    assert got["b"]["commercial_use"] is None and len(got["b"]["notes"]) == 2 and got["b"]["needs_manual_review"]
    assert len(got["c"]["notes"]) == 2 and got["d"]["needs_manual_review"] and "Meta" in got["d"]["trademark_terms"]
    models = spark.createDataFrame([("m", "mlx", "TForCausalLM", 10), ("n", "mlx", None, None), ("o", "transformers", "Encoder", 100), ("p", "llama-cpp", None, 9), ("q", "unheard", "X", 9)], "aid string, engine string, architecture string, need long")
    issues = {r["aid"]: [tuple(i) for i in r["issues"]] for r in rules.preflight(models, spark.createDataFrame([("h", 12)], "machine string, ram_bytes long"), tables.engine_architectures(spark)).collect()}
    assert issues == {"m": [("warning", "tight-ram")], "n": [("warning", "unknown-architecture")], "o": [("error", "unsupported-architecture"), ("error", "insufficient-ram")], "p": [], "q": []}


def test_shipped_build_files_count_at_the_root_only_where_they_say_so(spark):
    from stockroom.functions import tables

    files = spark.createDataFrame([("t", "code", p) for p in ("run.sh", "x/run.sh", "x/Dockerfile.gpu", "requirements/a/b.txt", "x/requirements/a.txt", ".env.sample", "deep/Makefile")], "aid string, artifact_type string, path string")
    got = {r["label"]: r["paths"] for r in rules.declarations(files, tables.build_files(spark)).collect()}
    assert got == {"shell": ["run.sh"], "container": ["x/Dockerfile.gpu"], "python": ["requirements/a/b.txt"], "env_template": [".env.sample"]}


def test_migration_leaves_other_majors_alone(spark):
    from stockroom.operators import migrate

    schema = "aid string, schema_version string, artifact_type string, origin string, provider string, repo_id string, address string, base_models array<string>, base_model_relation string, training_datasets array<string>, source_datasets array<string>, tags array<string>, policy string, verdicts array<string>, payload_root string"
    none = (None,) * 13
    rows = [("new", "2.0.0", "model", "hub", None, "o/n", None, ["a/b"], None, None, None, None, "masters", None, None), ("next", "3.1", *none), ("odd", "x", *none), ("null", None, *none), ("old", "1.4.0", None, "hub", None, "o/Net-7B", None, ["a/b"], "merge", None, None, ["base_model:merge:c/d"], "masters", ["keep"], None)]
    got = {r["aid"]: r for r in migrate.migrated(spark.createDataFrame(rows, schema)).collect()}
    assert {k: r["standing"] for k, r in got.items()} == {"new": "current", "next": "newer", "odd": "unreadable", "null": "unreadable", "old": "older"}
    assert got["new"]["policy"] == "masters" and got["new"]["changes"] == [] and got["new"]["identity"] is None
    old = got["old"]
    assert (old["address"], old["provider"], old["payload_root"], old["policy"], old["identity"]["size_total"]) == ("hub:o/Net-7B", "hub", "model/", "negatives", 7_000_000_000)
    assert [tuple(e) for e in old["parents"]] == [("hub:a/b", None, "card")]  # the recorded relation is what the tags agree on
