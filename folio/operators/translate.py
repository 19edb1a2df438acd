"""Translation batches: languages, front matter, skipping, requests, responses, outputs.

The model itself is a function handed in; without one, requests are planned and nothing is sent.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import at, replace_first, trim
from folio.operators.fmt import format_document
from folio.sources.ledger import Ledger, Refused

#: Language codes and names.
LANGUAGES = {
    "zh": "中文",
    "en": "English",
    "ja": "日本語",
    "ko": "한국어",
    "fr": "Français",
    "de": "Deutsch",
    "es": "Español",
    "it": "Italiano",
    "ru": "Русский",
    "pt": "Português",
    "vi": "Tiếng Việt",
    "th": "ไทย",
    "ar": "العربية",
    "hi": "हिन्दी",
}


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(LANGUAGES.items()), "code string, name string")


def is_supported(code: Column) -> Column:
    return code.isin(*LANGUAGES)


def listing() -> str:
    """``code (name)`` of every language, sorted, comma-separated."""
    return ", ".join(sorted(f"{c} ({n})" for c, n in LANGUAGES.items()))


def front_matter(text: Column) -> Column:
    """Struct ``yaml, body``: split at a leading ``---`` line and the next one; ``yaml`` is null without both."""
    rest = F.substring(text, F.lit(5), F.char_length(text))
    end = F.instr(rest, F.lit("\n---\n"))
    has = F.startswith(text, F.lit("---\n")) & (end > 0)
    yaml = F.when(has, F.substring(rest, F.lit(1), end - 1))
    body = F.when(has, F.substring(rest, end + 5, F.char_length(rest))).otherwise(text)
    return F.struct(yaml.alias("yaml"), body.alias("body"))


def second_removal(text: Column) -> Column:
    """What the request strips besides: if the trimmed text starts with ``---``, all up to the second ``---``."""
    parts = F.split(trim(text), "---", 3)
    return F.when(F.startswith(trim(text), F.lit("---")) & (F.size(parts) >= 3), trim(at(parts, 2))).otherwise(text)


@F.pandas_udf(T.BooleanType())
def says_translated(yaml: pd.Series) -> pd.Series:
    """Whether front matter holds ``translated: true`` as a boolean."""
    import yaml as lib

    def one(text):
        try:
            value = lib.safe_load(text) if text else None
        except lib.YAMLError:
            return False
        return isinstance(value, dict) and value.get("translated") is True

    return yaml.map(one).astype(bool)


@F.pandas_udf(T.StringType())
def marked_yaml(yaml: pd.Series) -> pd.Series:
    """Front matter with ``translated: true`` added, keys sorted."""
    import yaml as lib

    def one(text):
        try:
            value = lib.safe_load(text) if text else {}
        except lib.YAMLError:
            value = {}
        return lib.safe_dump({**(value if isinstance(value, dict) else {}), "translated": True}, sort_keys=True, allow_unicode=True, default_flow_style=False)

    return yaml.map(one)


def target_path(path: Column, lang: str, target_dir: str | None = None, source_dir: str | None = None) -> Column:
    """``name_<lang>.ext`` beside the source; with a target folder the tree below the source folder is mirrored there."""
    if target_dir is not None:
        below = F.substring(path, F.lit(len((source_dir or "").rstrip("/")) + 2), F.char_length(path)) if source_dir else path
        return F.concat(F.lit(target_dir.rstrip("/") + "/"), below)
    return F.regexp_replace(path, r"(?s)\A(.*?)(\.[^./]*)?\z", f"$1_{lang}$2")


def pending(docs: DataFrame, targets: DataFrame, lang: str, force: bool = False, **places) -> DataFrame:
    """Documents with ``target``, less those whose target exists and says it is translated (unless forced).

    ``targets`` is ``path, content`` of existing files.
    """
    planned = docs.withColumn("target", target_path(F.col("path"), lang, **places))
    if force:
        return planned
    done = targets.where(F.startswith("content", F.lit("---\n"))).where(says_translated(front_matter(F.col("content"))["yaml"])).select(F.col("path").alias("target"))
    return planned.join(done, "target", "left_anti")


def prompt(template: str, lang: str) -> Column:
    return replace_first(F.lit(template), F.lit("{TARGET_LANG}"), F.lit(lang))


def request_json(content: Column, lang: str, template: str, model: str, temperature: float = 0.0, top_p: float = 1.0) -> Column:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", prompt(template, lang)), message("user", second_removal(content))).alias("messages"), F.lit(temperature).alias("temperature"), F.lit(top_p).alias("top_p"))
    return F.to_json(body)


def response_text(body: Column) -> Column:
    """Content of the first choice, null if there is none or the body is no such JSON."""
    parsed = F.from_json(body, "choices array<struct<message:struct<role:string,content:string>>>")
    return at(parsed["choices"], 0)["message"]["content"]


def clean_response(text: Column) -> Column:
    """Without thinking blocks and one leading line feed."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>\n?", ""), r"\A\n", "")


def answered(client: Callable[[str], str]) -> Callable[[str], str]:
    """``client``, of which a response without a result is a failure, so that it stops a batch and is asked for again."""

    def call(body: str) -> str:
        response = client(body)
        try:
            text = json.loads(response)["choices"][0]["message"]["content"]
        except (ValueError, LookupError, TypeError):
            text = None
        if text is None:
            raise Refused("no translation result")
        return response

    return call


def call_model(requests: DataFrame, client: Callable[[str], str], request: str = "request", order: str | None = None, concurrency: int = 8, stop: bool = False, seconds: float | None = None, ledger: str | None = None) -> DataFrame:
    """``requests`` with ``response`` and ``error``; ``client`` maps a request body to a response body and runs on the executors.

    A request is known by a hash of its body: equal ones are asked once, and none a second time, whatever is read and whatever tasks fail; with ``ledger``, a
    folder, a later run asks only for what has no answer yet.  At most ``concurrency`` are asked at once, answers are committed as they come (see ``Ledger``), and with ``stop`` no
    more are begun after the first failure in ``order``.
    """
    asked = requests.drop("response", "error", "result")
    named = asked.select(F.struct(*([c for c in asked.columns if c != request] or [F.lit(0).alias("none")])).alias("row"), F.col(request).alias("request"), F.sha2(F.col(request), 256).alias("key"), (F.col(order) if order else F.lit("")).alias("order"))
    effects = Ledger(requests.sparkSession, "response string", ledger)
    lane = F.pmod(F.xxhash64("key"), F.lit(concurrency)).cast("string")
    got = effects.settle(named, lambda r: {"response": client(r)}, "key", "request", lane, "order", buckets=concurrency, threads=concurrency, seconds=seconds, stop=stop)
    return got.select(*[F.col("request").alias(c) if c == request else F.col("row")[c].alias(c) for c in asked.columns], "result.response", "error")


def output(yaml: Column, body: Column) -> Column:
    return F.concat(F.lit("---\n"), marked_yaml(yaml), F.lit("---\n\n"), body)


def before_failure(rows: DataFrame, order: str = "path") -> DataFrame:
    """``rows`` up to the first with an error, in order, with that one; all if none has."""
    first = rows.where("error IS NOT NULL AND NOT startswith(error, 'not asked')").agg(F.min(order).alias("first_failed"))
    return rows.join(F.broadcast(first), F.col("first_failed").isNull() | F.coalesce(F.col(order) <= F.col("first_failed"), F.lit(True))).drop("first_failed")  # one row is sent


def translate(docs: DataFrame, targets: DataFrame, lang: str, client: Callable[[str], str], template: str, model: str, force: bool = False, formatted: bool = False, fail_fast: bool = False, concurrency: int = 8, seconds: float | None = None, ledger: str | None = None, **options) -> DataFrame:
    """``path, target, output, error`` of the documents that are due. With ``fail_fast`` those after the first failing one, by path, are left out."""
    if lang not in LANGUAGES:
        raise ValueError(f"language not supported: {lang}; supported are {listing()}")
    places = {k: options.pop(k) for k in ("target_dir", "source_dir") if k in options}
    due = pending(docs, targets, lang, force, **places).withColumn("fm", front_matter(F.col("content")))
    asked = due.select("path", "target", F.col("fm.yaml").alias("yaml"), request_json(F.col("fm.body"), lang, template, model, **options).alias("request"))
    got = call_model(asked, answered(client), order="path", concurrency=concurrency, stop=fail_fast, seconds=seconds, ledger=ledger)
    got = got.withColumn("raw", response_text(F.col("response")))
    got = got.withColumn("error", F.coalesce("error", F.when(F.col("raw").isNull(), F.lit("no translation result")))).withColumn("body", clean_response(F.col("raw")))
    if formatted:
        got = format_document(got, "body").withColumn("body", F.col("formatted")).drop("formatted")
    if fail_fast:
        got = before_failure(got)
    return got.select("path", "target", F.when(F.col("error").isNull(), output(F.col("yaml"), F.col("body"))).alias("output"), "error")


def progress(docs: DataFrame, order: str = "path") -> DataFrame:
    """``docs`` with ``k`` and ``n`` (document k of n in order), numbered range by range rather than in one sorted task.

    The limits of the ranges are values, taken once from a bounded sample, so the job that counts the ranges and the one that numbers their rows cut alike
    whatever they read beside the order column.  Null comes first; rows of equal order are numbered in any order.
    """
    spark, key = docs.sparkSession, F.col(order)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = sorted({r[0] for r in docs.select(key).where(key.isNotNull()).orderBy(F.rand(7)).limit(100 * parts).collect()})
    cuts = [seen[i * len(seen) // parts] for i in range(1, parts)] if len(seen) > parts else seen[1:]
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= key)) if cuts else F.lit(0)
    ranged = docs.withColumn("_part", F.when(key.isNull(), F.lit(-1)).otherwise(part))
    before, total = {}, 0
    for r in sorted(ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a range
        before[r["_part"]], total = total, total + r["n"]
    base = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    k = F.row_number().over(Window.partitionBy("_part").orderBy(key.asc_nulls_first()))
    return ranged.withColumn("k", (F.try_element_at(base, F.col("_part")) + k).cast("long")).withColumn("n", F.lit(total)).drop("_part")
