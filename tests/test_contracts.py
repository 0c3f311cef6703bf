"""Rules on manifests, plans and scopes; published versions, runs, keyed tables and archives."""

import gzip
import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from graphloom.operators import scope
from graphloom.sources import files, ledger, xml
from graphloom.streaming import ingest

TABLES = {t: {"file": f"{t}.parquet"} for t in files.REQUIRED}
OWN = {"tables": TABLES, "bundle_version": "4"}


@pytest.mark.parametrize(
    ("manifest", "problems"),
    [
        (OWN, 0), ({**OWN, "tables": {"base_points": TABLES["base_points"], "base_clusters": {"rows": 3}}}, 1), ({**OWN, "tables": {**TABLES, "graph_points": {"file": "g"}}}, 1),
        ({**OWN, "tables": {**TABLES, "other": {"file": "o"}}}, 1), ({**OWN, "bundle_version": "five"}, 1), ({"tables": TABLES}, 0),
    ],
)
def test_manifests(manifest, problems):
    assert len(files.manifest_problems(files.normalised_manifest({"bundle_manifest": manifest, "bundle_version": "4"}))) == problems


def test_file_plans():
    manifest = {"papers": ["b/p2.jsonl.gz", "b/p1.jsonl.gz", "b/p3.jsonl.gz"], "authors": ["a.jsonl.gz"], "bioconcepts": ["c.gz"], "biocxml": ["x.tar.gz"]}
    assert files.manifest_checksum(manifest) == files.manifest_checksum(dict(reversed(manifest.items())))
    plan = files.file_plan(manifest, [*manifest], max_files=2)
    counts = {}
    for family, _, kind in plan:
        counts[family, kind] = counts.get((family, kind), 0) + 1
    assert counts == {("authors", "json"): 1, ("papers", "json"): 2, ("bioconcepts", "tsv"): 1, ("biocxml", "tar"): 1}


def test_needed_families():
    whole = {family: ["f.jsonl.gz"] for family in files.FAMILIES}
    assert not files.needed_missing(whole) and len(files.needed_missing({**whole, "papers": []})) == 1


def test_what_a_table_shows(spark):
    given = {"current": (True, True, "selection"), "selected": (False, True, "selection"), "dataset": (False, False, "selection")}
    assert all(scope.table_scope(*x) == name for name, x in given.items()) and scope.table_scope(True, True, "dataset") == "dataset"
    chosen = spark.range(3).select(F.col("id").alias("point_index"))
    assert scope.baseline_scope(scope.Selection(locked=True, baseline=chosen)) == "selected" and scope.baseline_scope(scope.Selection()) == "dataset"


# Published versions


def test_versions_are_pinned_refused_and_rolled_back(spark, tmp_path):
    published = ledger.Published(spark, f"file://{tmp_path}/t")
    with pytest.raises(LookupError):
        published.read()
    first = published.publish(spark.range(5))
    reader = published.read()
    second = published.publish(spark.range(9), expected=first)
    assert reader.count() == 5 and published.read().count() == 9 and published.read(first).count() == 5
    with pytest.raises(ledger.Rejected):
        published.publish(spark.range(3).withColumn("more", F.lit(1)))
    with pytest.raises(ledger.Rejected):
        published.publish(spark.range(0))
    with pytest.raises(ledger.Conflict):
        published.publish(spark.range(7), expected=first)

    def refuse(rows):
        raise ledger.Rejected("not these")

    with pytest.raises(ledger.Rejected):
        published.publish(spark.range(7), check=refuse)
    assert published.state()["version"] == second
    assert published.rollback() == first and published.read().count() == 5
    published.publish(spark.range(2).withColumn("more", F.lit(1)), new_schema=True)
    assert published.read().columns == ["id", "more"]


def test_two_writers_can_not_both_follow_a_state(spark, tmp_path):
    log = ledger.Log(spark, f"file://{tmp_path}/log")
    assert log.latest() == (-1, None)
    assert log.append(-1, {"a": 1}) == 0
    with pytest.raises(ledger.Conflict):
        log.append(-1, {"a": 2})
    assert log.append(0, {"a": 3}) == 1 and log.latest() == (1, {"a": 3}) and log.read(0) == {"a": 1}


def test_row_groups_of_a_version(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    published = ledger.Published(spark, f"file://{tmp_path}/t")
    published.publish(spark.range(0, 300_000, 1, 1))
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/t/versions/*/part-*")]
    assert [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)] == [122_880, 122_880, 54_240]


# Runs


def plan_of(*families, tag="r1"):
    return {"schema_version": 1, "source_code": "s", "release_tag": tag, "families": [{"family": f, "target_tables": [f], "files": [{"dataset": f, "byte_count": n, "content_kind": "json"}]} for f, n in families]}


def test_runs_resume_and_refuse_drift(spark, tmp_path):
    folder, done = f"file://{tmp_path}/runs", []
    plan = plan_of(("a", 1), ("b", 2), ("c", 3))

    def stops(family):
        if family["family"] == "b" and done.count("b!") == 0:
            done.append("b!")
            raise RuntimeError("lost")
        done.append(family["family"])

    with pytest.raises(RuntimeError):
        ledger.Run.open(spark, folder, plan).load(stops)
    for drifted in (plan_of(("a", 1), ("b", 9), ("c", 3)), plan_of(("a", 1), ("c", 3), ("b", 2)), plan_of(("a", 1), ("b", 2))):
        with pytest.raises(ledger.PlanDrift):
            ledger.Run.open(spark, folder, drifted)
    # What is loaded already may look different by now.
    run = ledger.Run.open(spark, folder, plan_of(("a", 77), ("b", 2), ("c", 3)))
    assert run.state["loaded"] == ["a"]
    run.load(stops)
    assert done == ["a", "b!", "b", "c"] and run.state["status"] == "published"
    with pytest.raises(ledger.AlreadyPublished):
        ledger.Run.open(spark, folder, plan)
    again = ledger.Run.open(spark, folder, plan, force_new=True)
    assert again.state["loaded"] == [] and again.state["run"] != run.state["run"]
    with pytest.raises(ledger.InProgress):
        ledger.Run.open(spark, folder, plan, force_new=True)
    states = [(r.status, r.loaded) for r in ledger.ledger(spark, folder, "s-r1").orderBy("number").collect()]
    assert states[:5] == [("started", 0), ("loading", 0), ("loading", 1), ("loading", 1), ("failed", 1)]


def test_an_abort_ends_a_run_before_the_next_family(spark, tmp_path):
    folder, done = f"file://{tmp_path}/runs", []

    def asks(family):
        done.append(family["family"])

    plan = plan_of(("a", 1), ("b", 2))
    ledger.Run.open(spark, folder, plan)
    ledger.request_abort(spark, folder, "s-r1")
    with pytest.raises(ledger.Aborted):
        ledger.Run.open(spark, folder, plan)
    ledger.Run.open(spark, folder, plan).load(asks)  # an aborted run is taken up when it is opened again
    assert done == ["a", "b"]


# Keyed tables


def test_batches_fold_into_the_last_row_of_each_key(spark, tmp_path):
    rng, want = random.Random(4), {}
    schema = spark.createDataFrame([], "key long, at long, value string").schema
    keyed = ingest.KeyedTable(spark, f"file://{tmp_path}/keyed", ["key"], ["at"], schema)
    assert keyed.current().count() == 0
    bases = set()
    for number in range(7):
        rows = [(rng.randint(0, 15), rng.randint(0, 50), f"{number}-{i}") for i in range(6)]
        rows = list({r[:2]: r for r in rows}.values())
        keyed.merge(spark.createDataFrame(rows, schema), number)
        for key, at, value in rows:
            if key not in want or (at, number) >= want[key][:2]:
                want[key] = (at, number, value)
        keyed.merge(spark.createDataFrame([(99, 99, "again")], schema), number)  # run again: changes nothing
        bases.add(keyed.log.latest()[1]["base"])
        assert {(r.key, r.at, r.value) for r in keyed.current().collect()} == {(k, a, v) for k, (a, _, v) in want.items()}
    assert 1 < len(bases) < 7  # folded sometimes, not always


# Archives


def archive(path, members, cut=None):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    packed = gzip.compress(raw.getvalue())
    path.write_bytes(packed[: int(cut * len(packed))] if cut else packed)


def document(i):
    noise = "".join(chr(random.Random(i).randint(97, 122)) for _ in range(2000))
    return f"<document><id>{i}</id><passage><offset>0</offset><text>t {i} \xe9 {noise}{random.Random(-i).random()}</text></passage></document>"


def test_archives_are_streamed_and_damage_is_told(spark, tmp_path):
    member = lambda ids: ("<?xml version='1.0'?><collection>" + "\n".join(map(document, ids)) + "</collection>").encode()
    archive(tmp_path / "a.tar.gz", [("x/1.xml", member(range(0, 40))), ("x/note.txt", b"\xff\xfe nothing"), ("x/2.XML", member(range(40, 70)))])
    sound = f"file://{tmp_path}/a.tar.gz"
    got = xml.archived_documents(spark, sound)
    assert sorted(r.xml for r in got.collect()) == sorted(map(document, range(70)))
    assert {r.pmid for r in xml.parsed(got).collect()} == set(range(70))
    archive(tmp_path / "b.tar.gz", [("1.xml", member(range(100, 400)))], cut=0.6)
    both = f"file://{tmp_path}/*.tar.gz"
    with pytest.raises(Exception):  # noqa: B017
        xml.archived_documents(spark, both).collect()
    kept = {r.pmid for r in xml.parsed(xml.archived_documents(spark, both, tolerant=True)).collect()}
    assert set(range(70)) <= kept and {100, 150} <= kept and 399 not in kept
    report = {r.archive.rsplit("/", 1)[1]: (r.documents, r.complete) for r in xml.archive_report(spark, both).collect()}
    assert report["a.tar.gz"] == (70, True) and report["b.tar.gz"][1] is False and 0 < report["b.tar.gz"][0] < 300
