"""Sources and table functions: what is missing, broken, long or cut short."""

import random

import pytest
from pyspark.sql import functions as F

from sparkstave.functions import one_to_many, scalars
from sparkstave.operators import notes as nt
from sparkstave.operators import similarity
from sparkstave.sources import scores, tables

SCORE = """<?xml version="1.0"?><score xmlns="urn:x"><part-list/><part id="A"><measure number="1"><attributes><time><senza-misura/></time><key><fifths>-1</fifths></key></attributes>
<note><pitch><step>C</step><octave>4</octave></pitch><duration>2</duration><tie type="start"/></note></measure><measure number="x"><backup><duration>1</duration></backup></measure></part>
<part id="B"><measure/></part></score>"""


def test_free_metre_is_a_time(spark):
    rows = nt.score_elements(spark.createDataFrame([("f", SCORE)], "file string, content string")).withColumn("side", F.lit("gt"))
    assert {(r["kind"], r["key"]) for r in nt.attribute_events(rows).collect()} == {("time", "0:1:0:0"), ("key", "0:1:-1")}
    assert "TIME_0_0" in nt.structure_tokens(rows).first()["tokens"]


def test_source_reads_what_the_parser_does(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scores, "PIECE", 7)
    monkeypatch.setattr(scores, "PART", 900)
    files = {"a.xml": SCORE, "b/c.xml": SCORE.replace("C</step>", "D</step>"), "broken.xml": SCORE[:-20], "none.xml": "<score/>", "empty.xml": "", "long.xml": "<s><part>" + "<measure><note/></measure>" * 500 + "</part></s>"}
    for name, content in {**files, "skipped.txt": SCORE, "_hidden.xml": SCORE}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    scores.register(spark)
    got = spark.read.format("scores").load(str(tmp_path))
    want = nt.score_elements(spark.createDataFrame(list(files.items()), "file string, content string"))
    assert sorted(map(str, got.drop("error").collect())) == sorted(map(str, want.drop("error").collect()))
    assert {r["file"] for r in got.filter("error is not null").collect()} == {"broken.xml", "none.xml", "empty.xml"} and got.rdd.getNumPartitions() > 2
    assert spark.read.format("scores").load(str(tmp_path / "nowhere")).count() == 0


def test_a_small_file_is_opened_once(tmp_path, monkeypatch):
    good, bad, long = "<score><part><measure number='1'><note/></measure></part></score>", "<score><part>", "<score><part>" + "<measure/>" * 20_000 + "</part></score>"
    for name, content in (("a.xml", good), ("b.xml", bad), ("c.xml", long)):
        (tmp_path / name).write_text(content)
    opened, real = [], scores.file_system

    class System:
        def __init__(self, system):
            self.system = system

        def open_input_stream(self, path):
            opened.append(path[-5:])
            return self.system.open_input_stream(path)

    reader = scores.ScoreReader(str(tmp_path), (".xml",))
    parts = reader.partitions()
    monkeypatch.setattr(scores, "file_system", lambda path: (System((found := real(path))[0]), found[1]))
    rows = [r for part in parts for r in reader.read(part)]
    assert [sum(r[0] == x for r in rows) for x in ("a.xml", "b.xml", "c.xml")] == [2, 1, 20_000]
    assert (opened.count("a.xml"), opened.count("b.xml"), opened.count("c.xml")) == (1, 1, 3)


def test_listing_is_sorted_and_may_be_empty(spark, tmp_path):
    assert tables.list_files(spark, str(tmp_path / "nowhere"), ".xml").count() == 0
    for name in ("b.xml", "a/z.xml", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    assert [tuple(r) for r in tables.list_files(spark, str(tmp_path), ".xml").collect()] == [("z.xml", "a/z.xml", 7), ("b.xml", "b.xml", 5)]


def test_first_lines_in_file_order(spark, tmp_path):
    for name, numbers in (("a.json", range(900, 400, -1)), ("b.json", range(100))):
        (tmp_path / name).write_text("\n\n".join(f'{{"n": {n}}}' for n in numbers) + "\n")
    schema = spark.createDataFrame([(1,)], "n int").schema
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert [r["n"] for r in tables.read_json_lines(spark, str(tmp_path), schema, first=505).collect()] == [*range(900, 400, -1), 0, 1, 2, 3, 4]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_to_many_of_lists_and_texts(spark):
    one_to_many.register(spark)
    df = spark.createDataFrame([(1, "a,b", [1.5, None]), (2, "", []), (3, None, None)], "id int, text string, list array<double>")
    assert [tuple(r) for r in spark.sql("SELECT d.id, x.* FROM {d} d, LATERAL one_to_many(d.text, ',') x ORDER BY id, place", d=df).collect()] == [(1, 0, "a"), (1, 1, "b"), (2, 0, "")]
    found = spark.sql("SELECT d.id, x.item FROM {d} d, LATERAL one_to_many(d.list) x", d=df)
    assert found.schema["item"].dataType.simpleString() == "double" and sorted(map(str, (r["item"] for r in found.collect()))) == ["1.5", "None"]
    with pytest.raises(Exception, match="one_to_many takes"):
        spark.sql("SELECT x.* FROM {d} d, LATERAL one_to_many(d.id) x", d=df).collect()


def plain_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(20))
def test_distances_by_diagonals_and_by_bits(seed):
    rng = random.Random(seed)
    x = [rng.choice("abc") for _ in range(rng.randrange(60))]
    y = list(x) if seed % 2 else [rng.choice("abc") for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(12)):
        at = rng.randrange(len(y) + 1)
        y[at : at + rng.randrange(3)] = [rng.choice("abd")] * rng.randrange(3)
    want = plain_distance(x, y)
    a, b = ([ord(c) for c in s] for s in (x, y))
    assert scalars.token_distance(x, y) == scalars.bit_distance(x, y) == want
    import numpy as np

    assert scalars.diagonal_distance(np.array(a, int), np.array(b, int), 200) == want and scalars.diagonal_distance(np.array(a, int), np.array(b, int), want - 1) is None


def test_long_near_lists_take_linear_time():
    import time

    x = list(range(300_000))
    y = [*x[:1000], -1, *x[1000:150_000], *x[150_040:]]
    began = time.perf_counter()
    assert scalars.token_distance(x, y) == 41 and time.perf_counter() - began < 5


def test_files_of_equal_names_stay_apart(spark, tmp_path):
    rows = spark.createDataFrame([("7", " a\nb "), ("7", "c"), ("8", "")], "name string, value string").coalesce(1)
    tables.write_files(rows, f"file:{tmp_path}/texts")
    read = tables.read_whole_texts(spark, f"{tmp_path}/texts", deep=True)
    assert sorted((r["name"].split("-")[0], r["content"]) for r in read.collect()) == [("7", "a\nb"), ("7", "c"), ("8", "")]


def test_the_driver_lists_no_file_of_a_deep_folder(spark, tmp_path, monkeypatch):
    """Folders hold a few files each and are listed by the tasks that read them; what Spark's readers pass over is passed over."""
    monkeypatch.setattr(tables, "FILES", 4)
    monkeypatch.setattr(tables, "READ", 20)
    tables.write_files(spark.range(30).selectExpr("cast(id as string) AS name", "concat(' text ', id, '\n') AS value").repartition(3), f"{tmp_path}/texts")
    assert max(len(list(x.iterdir())) for x in (tmp_path / "texts").iterdir()) == 4
    (tmp_path / "texts/a/b").mkdir(parents=True)
    (tmp_path / "texts/_c").mkdir()
    for name in ("top.txt", ".top.txt", "a/b/low.txt", "_c/no.txt"):
        (tmp_path / "texts" / name).write_text(f"{name}\r\n x ")
    (tmp_path / "texts/empty.txt").write_text("")
    read = tables.read_whole_texts(spark, f"file:{tmp_path}/texts", deep=True)
    assert read.inputFiles() == []
    want = [(str(k), f"text {k}") for k in range(30)] + [("low.txt", "a/b/low.txt\r\n x"), ("top.txt", "top.txt\r\n x")]
    assert sorted((r["name"].split("-")[0], r["content"]) for r in read.collect()) == sorted(want)
    alone = tables.read_whole_texts(spark, f"{tmp_path}/texts/a/b/low.txt", deep=True)
    assert [tuple(r) for r in alone.collect()] == [("low.txt", "a/b/low.txt\r\n x")]


def test_many_small_scores_are_read_in_many_parts(tmp_path):
    for k in range(2500):
        (tmp_path / f"{k}.xml").write_text("<score><part/></score>")
    parts = scores.ScoreReader(str(tmp_path), (".xml",)).partitions()
    assert len(parts) == 3 and sum(len(p.paths) for p in parts) == 2500


def test_markup_and_timelines_are_held_in_part(spark, monkeypatch):
    """A batch of files gives its rows in small batches, and timelines of a batch are made dense a few at a time; both change no result."""
    good = "<score><part><measure number='1'>" + "<note><duration>1</duration></note>" * 40 + "</measure></part></score>"
    files = spark.createDataFrame([(f"f{k}", good if k % 3 else x) for k, x in enumerate(["<score>", "", None, "<score/>"] * 5)], "file string, content string").coalesce(1)
    cells = spark.range(600).selectExpr("concat('f', id % 9) AS file", "if(id % 2 = 0, 'gt', 'pred') AS side", "cast(id * 7 % 90 as int) AS frame", "cast(id % 5 as int) AS slot")
    by = lambda df: sorted(df.collect(), key=str)
    rows, warped = by(nt.score_elements(files)), by(similarity.timeline_dtw(cells))
    assert sum(r["error"] is not None for r in rows) == 7 and len(rows) == 7 + 13 * 41
    monkeypatch.setattr(nt, "OUT_ROWS", 7)
    monkeypatch.setattr(similarity, "HELD", 200)
    assert by(nt.score_elements(files)) == rows and by(similarity.timeline_dtw(cells)) == warped


def test_batched_map_makes_no_python_strings(spark, small_dir):
    from sparkstave.plans import registry

    assert "MapInArrow" in registry.queries()["v01_batched_map"](spark, small_dir)._jdf.queryExecution().toString()
