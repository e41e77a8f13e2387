import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from dishrank.catalog.standins import LEMMAS, LEXICON
from dishrank.operators.dictionary import parse_dictionary
from dishrank.plans import build
from dishrank.session import list_names, path_exists, work_path
from dishrank.sources import readers, stages, versions
from dishrank.sources.stages import Stages, files_digest, plan_text

TEXTS = [("b1", "The ramen was good. Two burgers came late!", "2024-01-01"), ("b2", "Bad ramen.", "2024-01-02"), ("b1", "No.", "2024-01-03")]
TEXT = "business_id string, text string, date string"
PLACES = [("b1", "One", "1 St", "Las Vegas", "NV", 4.5, 10), ("b2", "Two", "2 St", "Austin", "TX", 3.5, 20)]
PLACE = "business_id string, name string, full_address string, city string, state string, stars double, review_count long"


class Job:
    """The batch job over written inputs; ``read`` counts the texts that it reads."""

    def __init__(self, spark):
        self.spark, self.read = spark, spark.sparkContext.accumulator(0)
        self.texts, self.business, self.root, self.words = (work_path(spark, n) for n in ("texts", "business", "stages", "words"))
        spark.createDataFrame(TEXTS, TEXT).coalesce(1).write.parquet(self.texts)
        spark.createDataFrame(PLACES, PLACE).write.parquet(self.business)
        spark.createDataFrame([("soup:ramen",), ("grill:burger",)], "value string").write.text(self.words)
        self.dishes, self.businesses = work_path(spark, "dishes"), work_path(spark, "businesses")

    def run(self):
        spark, read = self.spark, self.read

        @F.udf("string")
        def counted(text):
            read.add(1)
            return text

        step = Stages(spark, self.root)
        reviews = spark.read.schema(TEXT).parquet(self.texts).withColumn("text", counted("text"))
        inline = {n: spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows))} AS t({names})") for n, rows, names in (
            ("lemmas", LEMMAS, "form, lemma"), ("lexicon", LEXICON, "word, polarity"),
        )}
        joined = build.dish_ratings(
            reviews, reviews.where("date = '2024-01-02'"), spark.read.schema(PLACE).parquet(self.business),
            readers.read_dictionary(spark, self.words), inline["lemmas"], inline["lexicon"], stage=step,
        )
        build.publish(joined, self.dishes, self.businesses, stage=step)
        return step


def test_a_job_stopped_between_its_sinks_reads_no_text_again(spark, rows, monkeypatch):
    job = Job(spark)
    with monkeypatch.context() as patch:
        patch.setattr(build, "publish_businesses", lambda *a: (_ for _ in ()).throw(RuntimeError("the second sink fails")))
        with pytest.raises(RuntimeError):
            job.run()
    assert path_exists(spark, job.dishes) and not path_exists(spark, job.businesses)
    read = job.read.value
    assert read >= len(TEXTS)
    again = job.run()
    assert job.read.value == read and again.written == [] and len(again.used) == 3
    assert rows(readers.read_dishes(spark, job.dishes).select("dish", "businessid", "numreviews")) == [
        ("burger", "b1", 1), ("ramen", "b2", 2),
    ]
    assert rows(readers.read_published_businesses(spark, job.businesses).select("businessid")) == [("b1",), ("b2",)]


def test_a_job_stopped_in_its_last_stage_goes_on_from_the_one_before(spark, monkeypatch):
    job = Job(spark)
    whole = Stages.__call__

    def stopped(self, rows, name):
        if name == "joined":
            raise RuntimeError("lost")
        return whole(self, rows, name)

    with monkeypatch.context() as patch:
        patch.setattr(Stages, "__call__", stopped)
        with pytest.raises(RuntimeError):
            job.run()
    read = job.read.value
    assert [name.partition("-")[0] for name in job.run().written] == ["joined"] and job.read.value == read


def test_changed_inputs_and_plans_make_new_stages(spark):
    job = Job(spark)
    first = job.run()
    spark.createDataFrame([("b2", "Good burger.", "2024-01-04")], TEXT).write.mode("append").parquet(job.texts)
    second = job.run()
    # The dictionary is the same, so its patterns are; all that read texts are new.
    assert [name.partition("-")[0] for name in second.written] == ["mentions", "joined"]
    assert first.used[0] == second.used[0]
    assert len(list_names(spark, job.root)) == 5
    second.sweep()
    assert sorted(second.used) == list_names(spark, job.root)
    step = Stages(spark, job.root)
    texts = spark.read.schema(TEXT).parquet(job.texts)
    names = {step.digest(df) for df in (texts, texts.where("date > '2024'"), texts.where("date > '2025'"), texts.limit(1))}
    assert len(names) == 4 and Stages(spark, job.root, release="2").digest(texts) not in names


def test_an_unfinished_attempt_is_not_read(spark, rows, monkeypatch):
    job, texts = Job(spark), None
    texts = spark.read.schema(TEXT).parquet(job.texts)
    with monkeypatch.context() as patch:
        patch.setattr(stages, "switch_to", lambda *a: (_ for _ in ()).throw(RuntimeError("died before the pointer")))
        with pytest.raises(RuntimeError):
            Stages(spark, job.root)(texts, "copy")
    step = Stages(spark, job.root)
    assert rows(step(texts, "copy")) == rows(texts) and len(step.written) == 1
    assert rows(Stages(spark, job.root)(texts, "copy")) == rows(texts)


def test_digests_follow_names_sizes_and_times(spark):
    job = Job(spark)
    before = files_digest(spark, [job.texts])
    assert before == files_digest(spark, [job.texts]) and spark.conf.get("spark.sql.files.maxPartitionBytes") != str(1 << 40)
    data = next(os.path.join(job.texts, n) for n in os.listdir(job.texts) if n.startswith("part-"))
    later = time.time() + 60
    os.utime(data, (later, later))
    assert files_digest(spark, [job.texts]) != before


def test_rows_without_a_name_are_refused(spark):
    with pytest.raises(ValueError):
        Stages(spark, work_path(spark, "stages"))(spark.createDataFrame([(1,)], "a int").rdd.toDF(), "x")
    small = [spark.sql(f"SELECT * FROM VALUES (1, 'a'), ({n}, 'b') AS t(k, v)") for n in (2, 2, 3)]
    step = Stages(spark, work_path(spark, "stages"))
    assert step.digest(small[0]) == step.digest(small[1]) != step.digest(small[2])


SCRIPT = """
import sys
from dishrank.session import get_session
from dishrank.sources.stages import Stages
spark = get_session("other", "local[2]", spark__checkpoint__dir=sys.argv[2])
df = spark.range(3).select("id")
t = spark.read.schema("business_id string, text string, date string").parquet(sys.argv[1])
t.createOrReplaceTempView("t")
wide = spark.sql("WITH c AS (SELECT text, count(*) n FROM t GROUP BY text) SELECT a.*, " + ", ".join(f"n + {i} AS n{i}" for i in range(60))
    + " FROM c JOIN t a USING (text) WHERE a.date IN (SELECT max(date) FROM t)")
print("digest", Stages(spark, sys.argv[2]).digest(wide))
"""


def test_digests_hold_in_another_application(spark, tmp_path):
    job = Job(spark)
    found = set()
    for _ in range(2):
        run = subprocess.run([sys.executable, "-c", SCRIPT, job.texts, str(tmp_path)], capture_output=True, text=True, timeout=300)
        found.add(next(line for line in run.stdout.splitlines() if line.startswith("digest")))
    assert len(found) == 1
    text = plan_text(spark.read.schema(TEXT).parquet(job.texts).selectExpr(*[f"text AS t{i}" for i in range(60)]))
    assert "t59" in text


# Tables of versions.

SCHEMA = "citystate string, dish string, n int"


def put(spark, path, version, data, **more):
    versions.write_version(spark.createDataFrame(data, "dish string, n int, citystate string"), path, version, "citystate", ["dish"], **more)


def seen(spark, path, version=None):
    schema = spark.createDataFrame([], "dish string, n int, citystate string").schema
    return versions.read_version(spark, path, schema, "citystate", version)


def test_a_reader_sees_one_version_during_a_rewrite(spark, rows, monkeypatch):
    path = work_path(spark, "table")
    with pytest.raises(FileNotFoundError):
        seen(spark, path)
    put(spark, path, "v1", [("x", 1, "A"), ("y", 1, "B"), ("z", 1, "C, D/é=")])
    old = [("x", 1, "A"), ("y", 1, "B"), ("z", 1, "C, D/é=")]
    during = []
    switch = versions.switch_to

    def watched(spark, path, version):
        # All files of the new version are there; nobody sees them yet.
        during.append(rows(seen(spark, path)))
        switch(spark, path, version)
        during.append(rows(seen(spark, path)))

    before = seen(spark, path)
    monkeypatch.setattr(versions, "switch_to", watched)
    put(spark, path, "v2", [("x", 2, "A"), ("new", 2, "E")])
    assert during == [old, [("new", 2, "E"), ("x", 2, "A"), ("y", 1, "B"), ("z", 1, "C, D/é=")]]
    # What was being read stays readable, and cities without new rows were not written again.
    assert rows(before) == old and rows(seen(spark, path, "whole-v1")) == old
    assert "citystate=B" not in list_names(spark, f"{path}/data/version=v2")


def test_a_version_that_fails_changes_nothing_and_may_run_again(spark, rows, monkeypatch):
    path = work_path(spark, "table")
    put(spark, path, "v1", [("x", 1, "A")])
    with monkeypatch.context() as patch:
        patch.setattr(versions, "switch_to", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            put(spark, path, "v2", [("x", 2, "A"), ("gone", 2, "B")])
    assert rows(seen(spark, path)) == [("x", 1, "A")]
    put(spark, path, "v2", [("x", 3, "A")])
    assert rows(seen(spark, path)) == [("x", 3, "A")]
    # Once it is in place, running it again does nothing.
    put(spark, path, "v2", [("x", 9, "A")])
    assert rows(seen(spark, path)) == [("x", 3, "A")]
    put(spark, path, "v3", [("only", 4, "Z")], whole=True)
    assert rows(seen(spark, path)) == [("only", 4, "Z")]


def test_old_folders_are_deleted_when_no_kept_version_names_them(spark, rows):
    path = work_path(spark, "table")
    for n in range(1, 5):
        put(spark, path, f"v{n}", [("x", n, "A")] + ([("y", n, "B/1")] if n < 3 else []))
    versions.vacuum(spark, path, "citystate", keep=2)
    assert rows(seen(spark, path)) == [("x", 4, "A"), ("y", 2, "B/1")] and rows(seen(spark, path, "v3")) == [("x", 3, "A"), ("y", 2, "B/1")]
    folders = {v: [c for c in list_names(spark, f"{path}/data/{v}") if "=" in c] for v in list_names(spark, f"{path}/data") if "=" in v}
    assert folders == {"version=v2": ["citystate=B%2F1"], "version=v3": ["citystate=A"], "version=v4": ["citystate=A"]}
    assert [v for _, v in versions.switches(spark, path)] == ["v2", "v3", "v4"]


def test_a_lookup_reads_one_folder(spark, rows):
    path = work_path(spark, "table")
    put(spark, path, "v1", [("x", 1, c) for c in "ABCDE"])
    plan = seen(spark, path).where("citystate = 'B'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(citystate" in plan and "Join" not in plan
    put(spark, path, "v2", [("x", 2, "A"), ("empty", 2, "")])
    plan = seen(spark, path).where("citystate = 'B'")._jdf.queryExecution().executedPlan().toString()
    assert "citystate#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # A key without a name is a key like any other.
    assert rows(seen(spark, path).where("citystate is null").select("dish")) == [("empty",)] and seen(spark, path).count() == 6
    put(spark, path, "v3", [("empty again", 3, "")])
    assert rows(seen(spark, path).where("citystate is null").select("dish")) == [("empty again",)] and seen(spark, path).count() == 6
