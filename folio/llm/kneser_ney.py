"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of order three over words, split at ASCII blanks, each text led by two start symbols and closed by an end symbol; words and grams are
64-bit hashes.  One model is made for each language that has trusted text, and one for all together if any document is of
another language.  It grows with the trusted text and is never pruned.  Trusted documents but those held out (one in ``held_out``, by a hash of
the id) are counted.

The interpolated log probability of any trigram is a sum of table entries::

    log p(w | u v) = base + gain1[w] + back2[v] + gain2[v w] + back3[u v] + gain3[u v w]

where ``base`` is the log probability that the lowest order leaves to a word that was not seen (all of them are one more kind of word),
``back`` the log weight that a seen context leaves to the lower order, and ``gain`` what a seen gram has above that; entries
that are absent count 0.  A document's log probability is therefore a join of its triples with these tables.

**Sharded count joins** (``ngrams``).  A triple belongs to the shard of its middle word, and shards are as many as ``shard_bytes`` of text
ask for.  Texts' triples are summed up within a task and sent to their shards as packed chunks; a shard adds them up and writes its distinct
triples and the continuation counts that follow from them.  Shards ask each other, word by word, for the continuation counts
that their bigrams back off to, and write their part of the model to the shared folder.  Documents' triples then go to the shards the same way (one request for
each word, whichever language model it asks), where each chunk is answered from the shard's file by one sum for each document.  Chunks of one shard are dealt to as many
tasks as their bytes ask for, so that requests about a frequent word are spread; a batch of documents then adds up its answers.  Documents are taken in ``rounds`` by a hash of the id, and the shuffle files of a
round are given up before the next, which bounds the disk that requests need.  Nothing depends on a size but the number of shards.

A middle word that is very frequent makes its shard's distinct triples as many as it has different neighbours; they are added up in one task.

A document's level is its perplexity after ``prior`` symbols of its language's typical (median held-out) perplexity have been added, so
that a few words do not decide.  It stays if its level is at most the threshold of its language: ``slack`` times the
``quantile`` of the levels of the held-out trusted documents of that language, relative to its typical perplexity and drawn towards the same quantile over all
languages as if by ``pull`` further documents.  Documents of a model without held-out documents are not judged and stay: a model of words
knows the texts that it counted by heart.

Defined cases: null text counts as empty; a document without text has null perplexity and does not stay; a null language is a language
of its own; without any trusted text every document with text stays, perplexity null;
rows alike in language and text share one score; trusted ids may repeat or be null (null never matches); an empty table gives an empty
result; other columns are ignored.  More than ``LANGUAGES`` different languages are an error: a table of them is held by every task.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import ngrams
from folio.llm.files import gone, open_store, put, take
from folio.llm.scratch import Scratch, partitions
from folio.llm.screen import screened
from folio.llm.shingles import arrow_bytes, word_hashes
from folio.llm.tokens import release

#: Name of the pooled model; language names are led by ``=`` (``?`` for null), so that none equals it.
POOLED = "*"
LANGUAGES = 100_000
#: Words of a chunk's texts together, and bytes of models that a task keeps open.
BATCH, OPEN = 2_000_000, 60_000_000


def _lang_key(col: str):
    return F.when(F.col(col).isNull(), F.lit("?")).otherwise(F.concat(F.lit("="), F.col(col).cast("string")))


def _batches(batches, langs: dict[str, int], marks: bool):
    """Of columns ``model, text`` and, with ``marks``, ``mark``: ``lang, words, first, marks`` of about ``BATCH`` words of one language at a time."""
    release()
    held: dict[int, list] = {}
    total = 0

    def flush():
        for lang, parts in held.items():
            sizes = np.concatenate([p[1] for p in parts])
            yield lang, np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([p[2] for p in parts])
        held.clear()

    for batch in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
        lang = np.array([langs.get(m, -1) for m in batch.column(0).to_pylist()], np.int64)
        words, first = word_hashes(*arrow_bytes(batch.column(1)), lower=False)
        sizes = np.diff(first)
        mark = batch.column(2).to_numpy() if marks else np.zeros(len(lang), np.int64)
        for one in np.unique(lang[lang >= 0]):
            mine = lang == one
            held.setdefault(int(one), []).append((words[np.repeat(mine, sizes)], sizes[mine], mark[mine]))
        total += len(words) + 2 * len(sizes)
        if total >= BATCH:
            total = 0
            yield from flush()
    yield from flush()


CHUNKS = "lang int, shard int, payload binary"


def _row(pa, schema: str, *values):
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields, strict=True)], names=[n for n, _ in fields])


def counted_chunks(texts: DataFrame, langs: dict[str, int], shards: int, pooled: int | None) -> DataFrame:
    """``CHUNKS`` of ``model, text``: each task's distinct triples with their counts, under their language and, if there is one, the pooled model."""

    def run(batches):
        import pyarrow as pa

        for lang, words, first, _ in _batches(batches, langs, False):
            symbols, at, _ = ngrams.sequences(words, first)
            for shard, names, u, v, w, _ in ngrams.dealt(symbols, at, shards):
                payload = ngrams.counted_chunk(names, u, v, w)
                for to in (lang,) if pooled is None else (lang, pooled):
                    yield _row(pa, CHUNKS, to, shard, payload)

    return texts.select("model", "text").mapInArrow(run, CHUNKS)


COUNTED = "lang int, shard int, sender int, numbers array<long>, payload binary"


def _grouped(batches, columns: int):
    """``(lang, shard), rows`` of sorted batches."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != key:
                if rows:
                    yield key, rows
                key, rows = row[:2], []
            rows.append(row[2:])
    if rows:
        yield key, rows


def add_up(chunks: DataFrame, uri: str, shards: int, parts: int) -> DataFrame:
    """Writes each shard's counts; rows are its summary (``sender`` -1) and, to other shards, the words whose continuation counts it asks for."""

    def run(batches):
        import pyarrow as pa

        store, root = open_store(uri)
        for (lang, shard), rows in _grouped(batches, 3):
            own = ngrams.Counts.gathered([p for (p,) in rows])
            rows.clear()
            put(store, f"{root}/counts-{lang}-{shard}", own.packed())
            spoken = np.flatnonzero(own.c1)
            put(store, f"{root}/words-{lang}-{shard}", ngrams.pack(ngrams.steps(own.words[spoken]), own.c1[spoken].astype("<u4")))
            yield _row(pa, COUNTED, lang, shard, -1, own.summary(), None)
            for to, codes in own.asked(shards):
                yield _row(pa, COUNTED, lang, to, shard, None, ngrams.pack(ngrams.steps(own.words[codes])))

    return chunks.repartition(parts, "lang", "shard").sortWithinPartitions("lang", "shard").mapInArrow(run, COUNTED)


def answered(asked: DataFrame, uri: str, parts: int) -> DataFrame:
    """``lang, shard, sender, payload``: what ``shard`` asked ``sender`` for."""

    def run(batches):
        import pyarrow as pa

        store, root = open_store(uri)
        for (lang, shard), rows in _grouped(batches, 4):
            names, c1 = ngrams.unpack(take(store, f"{root}/words-{lang}-{shard}"))
            names = ngrams.unstep(names)
            for sender, payload in rows:
                yield _row(pa, "lang int, shard int, sender int, payload binary", lang, sender, shard, ngrams.pack(c1[np.searchsorted(names, ngrams.unstep(ngrams.unpack(payload)[0]))]))

    return asked.select("lang", "shard", "sender", "payload").repartition(parts, "lang", "shard").sortWithinPartitions("lang", "shard").mapInArrow(run, "lang int, shard int, sender int, payload binary")


def finish(answers: DataFrame, every: DataFrame, uri: str, shards: int, languages: dict[int, list[int]], parts: int) -> DataFrame:
    """Writes each shard's part of the model; rows ``lang, shard``. ``every`` names all shards, also those that asked for nothing."""

    def run(batches):
        import pyarrow as pa

        store, root = open_store(uri)
        shared = {}
        for (lang, shard), rows in _grouped(batches, 4):
            if lang not in shared:
                shared[lang] = ngrams.Language(languages[lang])
            raw = take(store, f"{root}/counts-{lang}-{shard}", missing=True)
            if raw is None:  # they go once the model is there, so this task has run before
                if store.get_file_info(f"{root}/model-{lang}-{shard}").type.name == "NotFound":
                    raise FileNotFoundError(f"neither counts nor model of shard {shard}")
                yield _row(pa, "lang int, shard int", lang, shard)
                continue
            counts = ngrams.Counts.unpacked(raw)
            c1, got = np.zeros(len(counts.words), np.int64), {s: p for s, p in rows if s >= 0}
            for to, codes in counts.asked(shards):
                c1[codes] = ngrams.unpack(got[to])[0]
            put(store, f"{root}/model-{lang}-{shard}", ngrams.Model.made(counts, c1, shared[lang]).packed())
            gone(store, f"{root}/counts-{lang}-{shard}")
            yield _row(pa, "lang int, shard int", lang, shard)

    rows = answers.unionByName(every.select("lang", "shard", F.lit(-1).alias("sender"), F.lit(None).cast("binary").alias("payload")))
    return rows.repartition(parts, "lang", "shard").sortWithinPartitions("lang", "shard").mapInArrow(run, "lang int, shard int")


ASKED = "lang int, shard int, batch long, payload binary"


def requests(rows: DataFrame, langs: dict[str, int], shards: int) -> DataFrame:
    """``ASKED`` of ``model, text, mark``: all triples, document by document; under shard -1 the marks of a batch's documents.

    A batch is named by its marks, so a task that runs again over the same rows names it alike.
    """

    def run(batches):
        import pyarrow as pa

        for lang, words, first, marks in _batches(batches, langs, True):
            batch = int.from_bytes(hashlib.blake2b(marks.tobytes(), digest_size=8).digest(), "little", signed=True)
            yield _row(pa, ASKED, lang, -1, batch, ngrams.pack(marks))
            symbols, at, doc = ngrams.sequences(words, first)
            for shard, names, u, v, w, which in ngrams.dealt(symbols, at, shards):
                k = len(names)
                yield _row(pa, ASKED, lang, shard, batch, ngrams.pack(ngrams.steps(names), *(ngrams.narrow(c, k) for c in (u, v, w)), np.diff(doc[which], prepend=0).astype("<u4")))

    return rows.select("model", "text", "mark").mapInArrow(run, ASKED)


REPLY = "batch long, shard int, payload binary"


def replies(asked: DataFrame, uri: str, ends: dict[int, float], parts: int) -> DataFrame:
    """``REPLY`` for each request: of each document that it is about the weights of its triples and their number."""

    def run(batches):
        import pyarrow as pa

        store, root = open_store(uri)
        held: dict[tuple[int, int], ngrams.Model] = {}
        for batch in batches:
            for lang, shard, name, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard < 0:
                    yield _row(pa, REPLY, name, shard, payload)
                    continue
                if (lang, shard) not in held:
                    while held and sum(m.nbytes for m in held.values() if m) > OPEN:
                        held.pop(next(iter(held)))
                    raw = take(store, f"{root}/model-{lang}-{shard}", missing=True)
                    held[lang, shard] = ngrams.Model.unpacked(raw) if raw else None
                names, u, v, w, own = ngrams.unpack(payload)
                names, own = ngrams.unstep(names), np.cumsum(own, dtype=np.int64)
                model = held[lang, shard]
                weight = np.zeros(len(u)) if model is None else model.weights(names, u, v, w)
                weight = weight + ends[lang] * (names[w] == ngrams.END)
                docs = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                n = np.diff(np.append(docs, len(own)))
                yield _row(pa, REPLY, name, shard, ngrams.pack(np.diff(own[docs], prepend=0).astype("<u4"), np.add.reduceat(weight, docs).view(np.uint64), n.astype("<u4")))

    return asked.hint("rebalance", parts, "lang", "shard").sortWithinPartitions("lang", "shard").mapInArrow(run, REPLY)


SUMS = "mark long, sum double, n long"


def summed(answers: DataFrame, parts: int) -> DataFrame:
    """``SUMS``: of each document of each batch the sum of its replies."""

    def run(batches):
        import pyarrow as pa

        def row(marks, total, n):
            return pa.RecordBatch.from_arrays([pa.array(marks), pa.array(total), pa.array(n)], names=["mark", "sum", "n"])

        name, marks = None, None
        for batch in batches:
            for own, shard, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != name:
                    if name is not None:
                        yield row(marks, total, n)  # noqa: F821
                    name, marks = own, ngrams.unpack(payload)[0].view(np.int64)
                    total, n = np.zeros(len(marks)), np.zeros(len(marks), np.int64)
                elif shard >= 0:  # a batch that came twice has its marks twice and its sums twice, as it has two rows of each document
                    docs, sums, k = ngrams.unpack(payload)
                    docs = np.cumsum(docs, dtype=np.int64)
                    total[docs] += sums.view(np.float64)
                    n[docs] += k
        if name is not None:
            yield row(marks, total, n)

    return answers.repartition(parts, "batch").sortWithinPartitions("batch", "shard").mapInArrow(run, SUMS)


def train(texts: DataFrame, langs: dict[str, int], shards: int, scratch: Scratch, pooled: int | None = None) -> dict[int, ngrams.Language]:
    """Writes the models of ``model, text`` below ``scratch`` and returns what each one's shards share."""
    uri, parts = scratch.path("model"), partitions(texts.sparkSession)
    open_store(uri, create=True)
    found = scratch.keep(add_up(counted_chunks(texts, langs, shards, pooled), uri, shards, parts), "counted")
    scratch.give_up()
    summary = found.where("sender < 0")
    numbers = summary.select("lang", F.posexplode("numbers").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    languages: dict[int, list[int]] = {}
    for r in numbers.orderBy("lang", "i").collect():  # fifteen rows a language
        languages.setdefault(r["lang"], []).append(r["x"])
    answers = answered(found.where("sender >= 0"), uri, parts)
    scratch.keep(finish(answers, summary, uri, shards, languages, parts), "finished")
    scratch.drop("counted")
    scratch.give_up()
    return {lang: ngrams.Language(s) for lang, s in languages.items()}


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.985, slack: float = 1.05, prior: int = 40, held_out: int = 5, pull: int = 20, rounds: int = 4, shard_bytes: int = 64_000_000, carry: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, lang, n_symbols, perplexity, level, threshold, kept`` for each row of ``docs``; ``trusted`` names ids of trusted documents.

    Columns of ``docs`` named in ``carry`` follow, each under ``carried_`` and its name.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "kneser-ney")
    parts = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), _lang_key(lang_col).alias("key"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    ids = scratch.keep(trusted.select(F.col(trusted.columns[0]).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(held_out)) == 0), "trusted")
    counted = ids.where("NOT held").select("doc_id")
    sizes = rows.select("doc_id", "key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).where("size > 0")
    sizes = sizes.join(counted.withColumn("counted", F.lit(True)), "doc_id", "left").groupBy("key").agg(F.sum("size").alias("size"), F.count("counted").alias("n")).limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    shards = max(1, -(-sum(r["size"] for r in sizes) // shard_bytes))
    names = sorted(r["key"] for r in sizes if r["n"])
    langs = {k: i for i, k in enumerate(names)}
    pooled = len(langs) if len(langs) and len(langs) < len(sizes) else None
    languages: dict[int, ngrams.Language] = {}
    if langs:
        # an inner join with distinct ids: a semi join would be moved below the screen
        texts = screened(rows.select("doc_id", "key", "text").where("text != ''"), counted).join(counted.hint("merge"), "doc_id").select(F.col("key").alias("model"), "text")
        languages = train(texts, langs, shards, scratch, pooled)
    if pooled is not None:
        langs = {**langs, POOLED: pooled}
    has = spark.createDataFrame([(k,) for k in names], "has string")
    marked = rows.join(F.broadcast(has), F.col("key") == F.col("has"), "left").withColumn("model", F.coalesce("has", F.lit(POOLED))).drop("has").withColumn("mark", F.when(F.col("text") != "", F.xxhash64("key", "text")))
    sums = None
    ends = {i: x.end_gain for i, x in languages.items()}
    for r in range(rounds if langs else 0):
        mine = marked.where((F.col("text") != "") & (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(rounds)) == r))
        got = scratch.keep(summed(replies(requests(mine, langs, shards), scratch.path("model"), ends, parts), parts), f"sums{r}")
        scratch.give_up()
        sums = got if sums is None else sums.unionByName(got)
    scratch.drop("model")
    thin = marked.select("doc_id", "lang", "key", "model", "mark")
    n_words = F.when(F.col("mark").isNotNull(), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")
    if sums is None:
        none = F.lit(None).cast("double")
        return marked.select("doc_id", "lang", n_words.alias("n_symbols"), none.alias("perplexity"), none.alias("level"), none.alias("threshold"), F.col("mark").isNotNull().alias("kept"), *(f"carried_{c}" for c in carry))
    bases = spark.createDataFrame([(k, languages[i].base) for k, i in langs.items()], "model string, base double")
    scored = thin.where("mark IS NOT NULL").groupBy("mark", "model").agg(F.count(F.lit(1)).alias("copies")).join(F.broadcast(bases), "model").join(sums.groupBy("mark").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")), "mark")
    scored = scored.withColumn("n_symbols", (F.col("n") / F.col("copies")).cast("long")).withColumn("log_p", F.col("n_symbols") * F.col("base") + F.col("sum") / F.col("copies"))
    scored = scratch.keep(scored.select("mark", "model", "n_symbols", "log_p", F.exp(-F.col("log_p") / F.col("n_symbols")).alias("perplexity")), "scored")
    good = thin.join(ids.where("held"), "doc_id", "left_semi").select("mark").join(scored, "mark")
    good = scratch.keep(good.select("model", "n_symbols", "log_p", "perplexity"), "good")
    typical = scratch.keep(good.groupBy("model").agg(F.percentile_approx("perplexity", 0.5, 10_000).alias("typical")), "typical")
    level = F.exp((-F.col("log_p") + prior * F.log("typical")) / (F.col("n_symbols") + prior))
    far = good.join(F.broadcast(typical), "model").select("model", F.log(level / F.col("typical")).alias("far"))
    at = F.percentile_approx("far", quantile, 10_000)
    own = far.groupBy("model").agg(at.alias("own"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(far.agg(at.alias("of_all"))))  # of one row
    drawn = F.exp((F.col("n") * F.col("own") + pull * F.col("of_all")) / (F.col("n") + pull))
    limits = scratch.keep(own.join(typical, "model").select("model", "typical", (F.col("typical") * slack * drawn).alias("threshold")), "limits")
    decided = scored.join(F.broadcast(limits), "model", "left").select("mark", "n_symbols", "perplexity", level.alias("level"), "threshold")
    out = marked.join(decided, "mark", "left")
    kept = F.col("mark").isNotNull() & (F.col("threshold").isNull() | (F.col("level") <= F.col("threshold")))
    return out.select("doc_id", "lang", "n_symbols", "perplexity", "level", "threshold", kept.alias("kept"), *(f"carried_{c}" for c in carry))
