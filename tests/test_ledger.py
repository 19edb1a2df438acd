"""Effects happen once: counted by files that each call leaves."""

import os
import subprocess
import sys
import textwrap
import time
import uuid
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folio.operators import translate
from folio.plans import commands
from folio.sources import sitemap
from folio.sources.ledger import Ledger, Refused, lanes

CALLS = os.path.join(os.path.dirname(__file__), "..")


def counting(folder, answer):
    def call(x):
        Path(folder, f"{x.replace('/', '_')[:80]}~{uuid.uuid4().hex}").write_text(str(time.time()))
        return answer(x)

    return call


def calls(folder) -> Counter:
    return Counter(p.name.partition("~")[0] for p in Path(folder).iterdir())


def urls(spark, n, hosts=3):
    return spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h"), F.col("id") % hosts, F.lit("/p"), F.col("id") % (n // 2)).alias("url"))


def page(u):
    if u.endswith("7"):
        raise OSError("no route")
    return (404, "") if u.endswith("3") else (200, f"body of {u}")


def test_each_address_is_fetched_once(spark, tmp_path):
    """Over two outputs, several actions and repeated addresses."""
    df = urls(spark, 60)
    good, bad = sitemap.fetch(df, counting(tmp_path, page))
    assert [good.count(), bad.count()] * 2 == [good.count(), bad.count()] * 2
    assert {r["error"] for r in bad.collect()} == {"status 404", "OSError: no route"} and good.where("body = concat('body of ', url) AND status = 200").count() == good.count()
    assert good.count() + bad.count() == 60 and set(calls(tmp_path).values()) == {1}
    assert sum(calls(tmp_path).values()) == df.select("url").distinct().count()


def test_images_are_fetched_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"d/{i}.md", f"![a](https://x/{i % 4}.png) ![b](https://gone/{i}.png)") for i in range(10)], "doc_id long, path string, content string")

    def image(u):
        if "gone" in u:
            raise OSError("gone")
        return {"body": u.encode(), "content_type": "image/png"}

    new, files = commands.download(docs, counting(tmp_path, image))
    assert new.count() == 10 and files.count() == 4 and new.where("contains(content, 'https://gone/')").count() == 10
    assert calls(tmp_path) == Counter([f"https:__x_{i}.png" for i in range(4)] + [f"https:__gone_{i}.png" for i in range(10)])


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, None), (2, "https://h/1"), (2, "https://h/1")]])
def test_awkward_addresses(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, status string")
    good, bad = sitemap.fetch(df, counting(tmp_path, page))
    assert sorted((r["page_id"], r["status"]) for r in good.collect()) == [(2, 200)] * (len(rows) - 1 if len(rows) > 1 else 0)
    assert [r["error"] for r in bad.collect()] == ["nothing to ask"] * min(1, len(rows))
    assert sum(calls(tmp_path).values()) == (1 if len(rows) > 1 else 0)


def test_a_host_is_asked_in_lanes(spark, tmp_path):
    """Two lanes a host: never more than two calls at once, although one host has all addresses."""

    def slow(u):
        time.sleep(0.05)
        Path(tmp_path, f"end~{uuid.uuid4().hex}").write_text(str(time.time()))
        return 200, u

    sitemap.fetch(spark.range(24).select(F.concat(F.lit("https://Host/"), "id").alias("url")), counting(tmp_path, slow), per_host=2)
    events = sorted((float(p.read_text()), -1 if p.name.startswith("end~") else 1) for p in tmp_path.iterdir())
    at_once, most = 0, 0
    for _, step in events:
        at_once += step
        most = max(most, at_once)
    assert len(events) == 48 and 1 <= most <= 2
    assert spark.createDataFrame([("https://A.x/1",), ("https://a.x/2",), ("nothing",)], "u string").select(lanes(F.col("u"), 1).alias("l")).collect() == [("a.x#0",), ("a.x#0",), ("#0",)]


def test_deadline_and_time_limit(spark, tmp_path):
    def slow(u):
        time.sleep(30 if u.endswith("/1") else 0.3)
        return 200, u

    df = spark.createDataFrame([("https://h/0",), ("https://h/1",)], "url string")
    _, bad = sitemap.fetch(df, slow, seconds=1.0)
    assert [(r["url"], r["error"]) for r in bad.collect()] == [("https://h/1", "TimeoutError: no answer in 1 s")]
    asked = counting(tmp_path, slow)
    at = (tmp_path / "ledger").as_uri()
    many = spark.range(40).select(F.concat(F.lit("https://h/x"), "id").alias("url"))
    _, late = sitemap.fetch(many, asked, per_host=1, deadline=1.5, ledger=at)
    left = late.where("error = 'DeadlineExceeded: not asked'").count()
    assert 0 < left < 40
    good, late = sitemap.fetch(many, asked, per_host=8, ledger=at)
    assert good.count() == 40 and late.isEmpty()
    assert {v for k, v in calls(tmp_path).items() if k.startswith("https")} == {1}


def test_what_failed_is_asked_again(spark, tmp_path):
    broken = tmp_path / "broken"
    broken.touch()

    def sometimes(u):
        if u.endswith("2") and broken.exists():
            raise Refused("not today")
        return {"answer": u}

    seen = tmp_path / "calls"
    seen.mkdir()
    df = spark.range(6).select(F.concat(F.lit("k"), "id").alias("key"))
    ledger = Ledger(spark, "answer string", (tmp_path / "ledger").as_uri())
    first = ledger.settle(df, counting(seen, sometimes))
    assert [(r["key"], r["error"]) for r in first.where("error IS NOT NULL").collect()] == [("k2", "not today")]
    broken.unlink()
    assert ledger.settle(df, counting(seen, sometimes), again=False).where("error IS NOT NULL").count() == 1
    second = ledger.settle(df, counting(seen, sometimes))
    assert {r["key"]: r["result"]["answer"] for r in second.collect()} == {f"k{i}": f"k{i}" for i in range(6)}
    assert calls(seen) == Counter({"k2": 2, **{f"k{i}": 1 for i in (0, 1, 3, 4, 5)}})


DOCS = [(f"{i:02d}.md", f"text {i}") for i in range(30)]


def model(folder, broken=()):
    def answer(body):
        import json

        text = json.loads(body)["messages"][1]["content"]
        if text in broken:
            raise TimeoutError("late")
        return json.dumps({"choices": [{"message": {"content": f"done {text}"}}] if text != "text 25" else []})

    def call(body):
        import json

        Path(folder, f"{json.loads(body)['messages'][1]['content']}~{uuid.uuid4().hex}").write_text("")
        return answer(body)

    return call


def test_each_document_is_sent_to_the_model_once(spark, tmp_path):
    docs = spark.createDataFrame([*DOCS, ("copy.md", "text 3")], "path string, content string")
    got = translate.translate(docs, docs.limit(0), "de", model(tmp_path), "t", "m")
    for _ in range(3):
        assert got.count() == 31 and got.where("error IS NULL").count() == 30
    assert [(r["path"], r["error"]) for r in got.where("error IS NOT NULL").collect()] == [("25.md", "no translation result")]
    assert calls(tmp_path) == Counter(t for _, t in DOCS)


def test_a_batch_stops_at_the_first_failure_and_goes_on_later(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "path string, content string").where("path <> '25.md'")
    seen, at = tmp_path / "calls", (tmp_path / "ledger").as_uri()
    seen.mkdir()
    run = lambda broken: translate.translate(docs, docs.limit(0), "de", model(seen, broken), "t", "m", fail_fast=True, concurrency=2, ledger=at)
    first = run(("text 5", "text 9"))
    assert sorted((r["path"], r["error"]) for r in first.collect()) == [(f"{i:02d}.md", None if i < 5 else "TimeoutError: late") for i in range(6)]
    begun = calls(seen)
    assert {f"text {i}" for i in range(6)} <= set(begun) and set(begun.values()) == {1}
    second = run(())
    assert second.count() == 29 and second.where("error IS NOT NULL").isEmpty()
    after = calls(seen)
    assert {t for t, n in after.items() if n > 1} <= {"text 5", "text 9"} and len(after) == 29 and after["text 5"] == 2


def test_a_killed_task_asks_for_the_rest_only(tmp_path):
    """A worker dies in the middle of its bucket; the task runs again within the same job."""
    script = textwrap.dedent(f"""
        import os, sys, uuid
        from pathlib import Path
        sys.path.insert(0, {str(Path(CALLS).resolve())!r})
        from pyspark.sql import SparkSession
        from pyspark.sql import functions as F
        from folio.sources.ledger import Ledger
        spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        seen = Path({str(tmp_path)!r}, "calls"); seen.mkdir()
        def effect(k):
            if k == "k13" and not (seen.parent / "died").exists():
                (seen.parent / "died").touch()
                os._exit(1)
            Path(seen, k + "~" + uuid.uuid4().hex).touch()
            return {{"answer": k}}
        df = spark.range(20).select(F.concat(F.lit("k"), "id").alias("key"))
        got = Ledger(spark, "answer string").settle(df, effect, lane=F.lit("one"), order="key", flush=1)
        assert got.where("error IS NULL AND result.answer = key").count() == 20 and got.count() == 20
    """)
    subprocess.run([sys.executable, "-c", script], check=True, timeout=240, env={**os.environ, "PYTHONPATH": str(Path(CALLS).resolve())})
    assert (tmp_path / "died").exists() and calls(tmp_path / "calls") == Counter(f"k{i}" for i in range(20))


def test_small_files_are_put_together(spark, tmp_path):
    df = spark.range(50).select(F.concat(F.lit("k"), "id").alias("key"))
    got = Ledger(spark, "answer string", tmp_path.as_uri()).settle(df, lambda k: {"answer": k}, buckets=2, flush=1)
    assert got.where("result.answer = key").count() == 50 and len(list((tmp_path / "results").rglob("*.parquet"))) == 2


def test_an_attempt_whose_claim_is_taken_stops(spark, tmp_path):
    at = tmp_path / "ledger"

    def steal(k):
        for claim in (at / "claims").iterdir():
            claim.write_text("another")
        return {"answer": k}

    with pytest.raises(Exception, match="has taken over"):
        Ledger(spark, "answer string", at.as_uri()).settle(spark.createDataFrame([("a",)], "key string"), steal)


def test_what_is_asked_goes_out_in_waves(spark, tmp_path, monkeypatch):
    """However much is asked, a task is handed a bounded part of it at once; repeated keys are asked once over all waves, failing ones too, and with ``stop`` waves follow the order."""
    from folio.sources import ledger

    seen = tmp_path / "seen"
    seen.mkdir()

    def effect(k):
        (seen / uuid.uuid4().hex).write_text(k)
        if int(k[1:].split("-")[0]) % 7 == 3:
            raise OSError("no")
        return {"answer": k}

    sizes, real = [], ledger._waves
    monkeypatch.setattr(ledger, "WAVE_BYTES", 1)
    monkeypatch.setattr(ledger, "_waves", lambda files, most: sizes.append([len(w) for w in real(files, most)]) or real(files, most))
    df = spark.range(80).selectExpr("concat('k', lpad(id % 40, 3, '0'), '-', repeat('x', 200)) AS key").repartition(4)
    got = Ledger(spark, "answer string", (tmp_path / "l").as_uri()).settle(df, effect, buckets=2).collect()
    assert len(sizes[0]) > 1 and set(sizes[0]) == {1}
    assert len(got) == 80 and {r["key"]: r["error"] for r in got} == {f"k{i:03d}-" + "x" * 200: "OSError: no" if i % 7 == 3 else None for i in range(40)}
    assert sorted(p.read_text() for p in seen.iterdir()) == sorted({r["key"] for r in got})
    for p in seen.iterdir():
        p.unlink()
    Ledger(spark, "answer string", (tmp_path / "m").as_uri()).settle(df, effect, lane=F.lit("one"), order="key", buckets=1, stop=True).collect()
    assert sorted(p.read_text()[:4] for p in seen.iterdir()) == ["k000", "k001", "k002", "k003"]
