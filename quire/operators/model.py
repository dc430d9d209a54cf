"""Calls of a model over rows: reuse first, then calls with retries, errors as columns; and the loops built on them.

Each distinct prompt is asked for once, and the answers are cut to a table before they are used, so a lost task asks
only for its own rows again.  A failed call gives a status and never ends the job.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import prose
from quire.functions import rewrite as W
from quire.functions import text as T
from quire.operators import chunks as K
from quire.operators import detect as D
from quire.operators import enforce as E
from quire.operators import pairs as P
from quire.operators import prompts
from quire.operators import prose as PR
from quire.operators import repair as RP
from quire.operators import review as RV
from quire.operators import wavefront as WF
from quire.operators.calls import ANSWERS, Backend, Calls, caller
from quire.operators.lines import sections
from quire.operators.rows import rewritten
from quire.sources.answers import AnswerLog, signature
from quire.sources.io import Config
from quire.sources.runs import scratch_table, settled

@dataclass(frozen=True)
class StubBackend:
    """A model without a network: the prompt's text between its marks, with its words in small letters turned around.

    If ``flaky`` the first answer to each prompt is only a third of it.
    """

    flaky: bool = False

    def generate(self, prompt: str, attempt: int) -> str:
        text = prompt.partition('TEXT:\n"""')[2].removesuffix('"""') or prompt
        if self.flaky and attempt == 1:
            return text[: len(text) // 3]
        parts = WORDS.split(text)
        parts[1::2] = [(w[::-1] if w.islower() else w) if w.isalpha() else _turned(w) for w in parts[1::2]]
        return "".join(parts)


#: Letters and, rarely, numbers that are no decimal digits.
WORDS = re.compile(r"([^\W\d_]+)")


def _turned(mixed: str) -> str:
    words = ("".join(x) for _, x in groupby(mixed, str.isalpha))
    return "".join(w[::-1] if w.isalpha() and w.islower() else w for w in words)


@dataclass(frozen=True)
class Accept:
    """Whether an answer is as long as it should be."""

    most: float = 1.8
    least: float = 0.6

    def __call__(self, source: str, output: str) -> bool:
        return bool(output.strip()) and self.least <= len(output.strip()) / max(1, len(source.strip())) <= self.most


accept = Accept()


def filled(source: str, output: str) -> bool:
    """Whether there is an answer at all."""
    return bool(output.strip())


def ask(spark: SparkSession, rows: DataFrame, prompt: Column, backend: Backend | None = None, attempts: int | None = None, ok: Callable[[str, str], bool] = accept, calls: Calls | None = None) -> DataFrame:
    """``rows`` (text, ...) with hash, answer, status, attempts, seconds and error of the prompt that each makes."""
    calls = replace(calls or Calls(), **({} if attempts is None else {"attempts": attempts}))
    asked = rows.withColumn("prompt", prompt).withColumn("hash", F.sha2("prompt", 256))
    distinct = asked.groupBy("hash").agg(F.first("prompt").alias("prompt"), F.first("text").alias("text"))
    answers = scratch_table(spark, distinct.select("hash", "prompt", "text").mapInArrow(caller(backend or StubBackend(), calls, ok), ANSWERS), "answers")
    return asked.drop("prompt").join(answers, "hash")


def run(spark: SparkSession, chunks: DataFrame, backend: Backend | None = None, attempts: int = 3) -> DataFrame:
    """``chunks`` (doc_id, chunk_idx, text) with output, status, attempts and reused.

    Each distinct text is asked for once; the chunks that have it share the answer.  A text for which no answer is
    accepted keeps itself, with status failed.
    """
    rows = ask(spark, chunks.select("doc_id", "chunk_idx", "text"), F.coalesce("text", F.lit("")), backend, attempts)
    first = rows.groupBy("hash").agg(F.min(F.struct("doc_id", "chunk_idx")).alias("first"))
    out = rows.join(first, "hash").withColumn("reused", F.struct("doc_id", "chunk_idx") != F.col("first"))
    return out.select("doc_id", "chunk_idx", "text", "hash", F.coalesce("answer", "text").alias("output"), F.when(F.col("status") == "ok", "translated").otherwise("failed").alias("status"), "attempts", "reused")


def reassembled(parts: DataFrame, column: str = "output", separator: str = "\n\n") -> DataFrame:
    """(doc_id, text): the parts (doc_id, chunk_idx, column) of each document in their order."""
    whole = F.array_sort(F.collect_list(F.struct("chunk_idx", F.col(column).alias("x"))))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(whole, lambda p: p["x"]), separator).alias("text"))


def sectioned(spark: SparkSession, docs: DataFrame, split: bool, most: int) -> DataFrame:
    """(doc_id, chunk_idx, section, text): chunks that keep speeches whole, of each section by itself if ``split``; stubs go to the chunk behind them."""
    parts = sections(docs).select("doc_id", F.col("section_idx").alias("section"), F.col("body").alias("text")) if split else docs.select("doc_id", F.lit(0).cast("bigint").alias("section"), "text")
    parts = scratch_table(spark, parts.withColumn("part", F.monotonically_increasing_id()), "sections")  # numbers that stay
    cut = K.merge_stubs(K.chunk_quotes(parts.select(F.col("part").alias("doc_id"), "text"), most)).filter("text <> ''")
    rows = cut.select(F.col("doc_id").alias("part"), F.col("chunk_idx").alias("no"), "text").join(parts.select("part", "doc_id", "section"), "part")
    order = Window.partitionBy("doc_id").orderBy("section", "no")
    return rows.select("doc_id", (F.row_number().over(order) - 1).cast("bigint").alias("chunk_idx"), "section", "text")


def _signature(spark: SparkSession, task: str, config: Config, backend: Backend, language: str, glossary: DataFrame | None = None, **more) -> str:
    """What decides an answer besides its chunk: settings, model, the glossary's and the prompts' identities."""
    from quire.operators import glossary as G

    policy = spark.range(1).select(*[c.alias(k) for k, c in prompts.fingerprints(language).items()]).first().asDict()
    return signature(task=task, config=config, backend=repr(backend), language=language, prompts=policy, glossary=None if glossary is None else G.glossary_hash(glossary).first().hash, **more)


def translate(
    spark: SparkSession,
    docs: DataFrame,
    glossary: DataFrame | None = None,
    backend: Backend | None = None,
    language: str = "en",
    repair_too: bool = True,
    config: Config | None = None,
    cache: str | None = None,
    calls: Calls | None = None,
) -> DataFrame:
    """(doc_id, chunk_idx, source, output, status, attempts, retry_reason, issues, how, context): the chunks of documents, translated.

    Quotes of the source are mended, chunks keep speeches whole, stubs go to the chunk behind them.  Each prompt holds
    the glossary's terms of its chunk and the last paragraphs of its section, with their translations
    (``wavefront.run``).  Answers are parsed, cleaned, their quotes set as the source tells, terms enforced; what is
    worth it is repaired once.  Near copies take the answer of what they repeat.  With ``cache``, a path, answers are
    logged there, and those of equal settings are not asked for again.  ``config`` decides lengths, attempts, pauses,
    context and terms.
    """
    config, backend = config or Config(), backend or StubBackend()
    calls = calls or Calls.of(config, **({"pause": 0.0} if isinstance(backend, StubBackend) else {}))
    ready = docs.select("doc_id", W.separate_short_speeches(F.coalesce("text", F.lit(""))).alias("text"))
    ready = rewritten(ready, lambda t: PR._both(t, {"opened": PR.Q.mend_paragraphs, "balanced": PR.Q.balance}), ["opened", "balanced"])
    chunks = scratch_table(spark, sectioned(spark, ready, config.split_by_sections, config.translate_chunk_chars), "chunks")
    block = F.lit(None).cast("string")
    if glossary is not None:
        from quire.operators import glossary as G

        keyed = chunks.withColumn("at", F.concat_ws("-", "doc_id", "chunk_idx"))
        terms = G.chunk_terms(keyed, glossary, "at", config.glossary_match_limit, config.glossary_fallback_limit)
        terms = terms.select("at", "block", "terms", F.when(F.col("mode") == "matched", E.ruling(F.col("terms"))).alias("rules"))
        chunks, block = scratch_table(spark, keyed.join(terms, "at").drop("at"), "chunks"), F.col("block")
    told = [c for c in ("block", "terms", "rules") if c in chunks.columns]
    enforced = bool(told) and not chunks.filter("rules IS NOT NULL").isEmpty()
    ok = Accept(config.max_output_ratio)

    prompt = prompts.translation(F.col("text"), F.col("context"), block, T.classify_chunk(F.col("text")), language)
    answer = W.drop_marker_lines(F.coalesce(W.between_markers(F.coalesce("answer", "text")), F.col("text")))
    output = W.postprocess_translation(RP.guarded(F.col("text"), answer, answer, "translate"), F.col("text"))

    def answered(now: DataFrame) -> DataFrame:
        rows = ask(spark, now, prompt, backend, ok=ok, calls=calls)
        rows = rows.withColumns({"source": F.col("text"), "raw": F.col("answer"), "output": output})
        rows = PR.Q.chunk_quotes_of(rows, "output")
        rows = (E.put_through(rows, "output") if enforced else rows).withColumn("output", W.collapse_curly(F.col("output")))
        rows = rows.select("doc_id", "chunk_idx", "source", "raw", "output", "status", "attempts", *told)
        if repair_too:
            return repair(spark, rows, backend, language, calls, enforced)
        return rows.withColumn("issues", F.array().cast(f"array<{RP.ISSUE}>"))

    log = AnswerLog(spark, cache, _signature(spark, "translate", config, backend, language, glossary, repair=repair_too, terms="told and enforced")) if cache else None
    done = WF.run(spark, chunks, answered, WF.Context.of(config), log, "translate", extra=("issues",))
    rows = chunks.select("doc_id", "chunk_idx", F.col("text").alias("source")).join(done, ["doc_id", "chunk_idx"])
    status = F.when(F.col("status") == "ok", "translated").otherwise("failed")
    return rows.select("doc_id", "chunk_idx", "source", "output", status.alias("status"), "attempts", P.retry_reason(F.col("source"), F.col("output")).alias("retry_reason"), F.coalesce("issues", F.array().cast(f"array<{RP.ISSUE}>")).alias("issues"), "how", "context")


def repair(spark: SparkSession, rows: DataFrame, backend: Backend | None = None, language: str = "en", calls: Calls | None = None, enforced: bool = False) -> DataFrame:
    """``rows`` (doc_id, chunk_idx, source, output, ...) with issues; only rows with issues are asked for, and a candidate must hold.

    A candidate without fault and without the source's language replaces the output.  Rows with ``terms`` (and their
    ``block``) are held to these too; if ``enforced`` their ``rules`` are put through in a candidate.
    """
    issues, told = RP.shape_issues(F.col("source"), F.col("output"), language), [c for c in ("block", "rules") if "terms" in rows.columns]
    if told:
        issues = F.concat(issues, RP.told_issues(F.col("source"), F.col("output"), F.col("terms")))
    rows = scratch_table(spark, rows.withColumn("issues", issues), "to-repair")
    bad = rows.filter(F.size("issues") > 0).select("doc_id", "chunk_idx", F.col("output").alias("text"), "source", "issues", *told)
    if bad.isEmpty():
        return rows
    asked = ask(spark, bad, prompts.repair(F.col("source"), F.col("text"), F.col("issues"), F.col("block") if told else None, language), backend, 2, filled, calls)
    parsed = rewritten(asked.withColumn("given", F.coalesce("answer", F.lit(""))), lambda t: (prose.sanitized_refinement(t), 0), ["none"], ("given",), "plain").drop("none")
    candidate = W.postprocess_translation(F.coalesce(RP.parsed_repair(F.col("given")), F.col("plain")), F.col("source"))
    good = parsed.withColumn("candidate", candidate).filter(RP.candidate_fault(F.col("text"), F.col("candidate"), language).isNull() & D.residual_reason(F.col("candidate"), language).isNull() & (F.size(D.collapse_reasons(F.col("candidate"), F.length("text"))) == 0))
    good = (E.put_through(good, "candidate") if enforced else good).select("doc_id", "chunk_idx", "candidate")
    return rows.join(good, ["doc_id", "chunk_idx"], "left").withColumn("output", F.coalesce("candidate", "output")).drop("candidate")


def repair_segments(spark: SparkSession, rows: DataFrame, backend: Backend | None = None, language: str = "en") -> DataFrame:
    """``rows`` (doc_id, chunk_idx, text) whose paragraphs that are still in the source's language are translated again.

    A paragraph's candidate is taken if it is not empty, no longer in that language and not half as short; all else stays.
    """
    paragraphs = rows.select("doc_id", "chunk_idx", F.posexplode(T.paragraphs(F.col("text"))).alias("no", "text")).withColumn("leaks", D.residual_reason(F.col("text"), language).isNotNull())
    paragraphs = scratch_table(spark, paragraphs, "paragraphs")
    bad = paragraphs.filter("leaks").select("doc_id", "chunk_idx", "no", "text")
    asked = ask(spark, bad, prompts.translation(F.col("text"), None, None, F.lit("dialogue"), language), backend, 2, filled)
    new = W.postprocess_translation(RP.guarded(F.col("text"), F.col("answer"), F.coalesce(W.between_markers(F.col("answer")), F.lit("")), "translate"), F.col("text"))
    good = asked.withColumn("new", new).filter((F.col("new") != "") & D.residual_reason(F.col("new"), language).isNull() & (F.length(T.strip(F.col("new"))) >= F.length(T.strip(F.col("text"))) * 0.45))
    whole = paragraphs.join(good.select("doc_id", "chunk_idx", "no", "new"), ["doc_id", "chunk_idx", "no"], "left")
    parts = F.array_sort(F.collect_list(F.struct("no", F.coalesce("new", "text").alias("x"))))
    return whole.groupBy("doc_id", "chunk_idx").agg(F.array_join(F.transform(parts, lambda p: p["x"]), "\n\n").alias("text"), F.count("new").alias("replaced"))


def cleaned(spark: SparkSession, docs: DataFrame, mode: str) -> DataFrame:
    """(doc_id, text): all texts cleaned if ``mode`` is on, those that need it if it is auto, else none."""
    if mode == "on":
        return PR.cleanup(docs).select("doc_id", "text")
    if mode != "auto":
        return docs
    told = scratch_table(spark, PR.with_needs(docs), "needs")
    need = F.col("repeats") | F.col("glued")
    return PR.cleanup(told.filter(need)).select("doc_id", "text").union(told.filter(~need).select("doc_id", "text"))


def refine(spark: SparkSession, docs: DataFrame, backend: Backend | None = None, language: str = "en", config: Config | None = None, cache: str | None = None, calls: Calls | None = None) -> DataFrame:
    """(doc_id, text, chunks, refined, asked): documents refined chunk by chunk; a chunk whose answer breaks its structure stays.

    Prompts hold no context, so one round asks for all chunks; near copies take what they repeat was refined to, and with
    ``cache`` known answers are not asked for again.
    """
    config, backend = config or Config(), backend or StubBackend()
    calls = calls or Calls.of(config, **({"pause": 0.0} if isinstance(backend, StubBackend) else {}))

    def chunks() -> DataFrame:
        clean = cleaned(spark, docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), config.cleanup_before_refine)
        return K.chunk_strict(clean, config.refine_chunk_chars).select("doc_id", "chunk_idx", F.lit(0).alias("section"), "text")

    def answered(now: DataFrame) -> DataFrame:
        asked = ask(spark, now, prompts.refinement(F.col("text"), None, language), backend, calls=calls, ok=Accept(config.max_output_ratio))
        parsed = rewritten(asked.withColumn("given", F.coalesce("answer", F.lit(""))), lambda t: (prose.sanitized_refinement(t), 0), ["none"], ("given",), "clean").drop("none")
        judged = parsed.withColumn("r", RP.refined_chunk(F.col("text"), RP.guarded(F.col("text"), F.col("given"), F.col("clean"))))
        good = F.col("r.ok") & ~F.col("r.soft_retry") & (F.col("r.text") != "")
        return judged.select("doc_id", "chunk_idx", F.col("answer").alias("raw"), F.when(good, F.col("r.text")).otherwise(F.col("text")).alias("output"), F.when(good, "ok").otherwise("failed").alias("status"), "attempts")

    log = AnswerLog(spark, cache, _signature(spark, "refine", config, backend, language)) if cache else None
    parts = settled(spark, lambda: WF.at_once(spark, settled(spark, chunks, "chunks"), answered, log, "refine"), "refined")
    counts = parts.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("status") == "ok").alias("refined"), F.count_if(F.col("how") == "asked").alias("asked"))
    return PR.refined_finally(reassembled(parts)).join(counts, "doc_id")


def unbreak(spark: SparkSession, docs: DataFrame, backend: Backend | None = None, most: int = K.MAX_CHARS, calls: Calls | None = None) -> DataFrame:
    """(doc_id, text, scenes, wraps, hyphens, fallbacks): broken lines joined by a model, by rules where its answer is not accepted."""
    asked = ask(spark, scratch_table(spark, K.chunk_strict(docs, most), "chunks"), prompts.unbreaking(F.col("text")), backend, ok=filled, calls=calls)
    asked = asked.withColumn("given", W.unbreak_output(F.coalesce("answer", F.lit(""))))
    quotes = T.has_line(F.coalesce("answer", F.lit("")), W.LONELY_ANSWER) | T.quote_inflation(F.col("text"), F.col("given"))
    bad = (F.col("given") == "") | (F.size(W.reflow_problems(F.col("text"), F.col("given"))) > 0)
    judged = asked.withColumn("rule", F.when(quotes, "reflow").when(bad, "join")).select("doc_id", "chunk_idx", "text", "given", "rule")
    judged = rewritten(judged.withColumn("broken", F.when(F.col("rule") == "reflow", F.col("text"))), lambda t: K.reflow_text(t), ["joins"], ("broken",), "reflowed").drop("joins")
    output = F.when(F.col("rule") == "reflow", F.col("reflowed")).when(F.col("rule") == "join", W.unbreak(F.col("text"))).otherwise(F.col("given"))
    parts = scratch_table(spark, judged.select("doc_id", "chunk_idx", output.alias("output"), F.col("rule").isNotNull().alias("fallback")), "unbroken")
    counts = parts.groupBy("doc_id").agg(F.count_if("fallback").alias("fallbacks"))
    return PR.unbroken_globally(reassembled(parts)).join(counts, "doc_id")


def reviewed(spark: SparkSession, pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(pair_id, text, score, issue_count): the final review of pairs (pair_id, source, target), and the checks of its result."""
    pairs = scratch_table(spark, pairs.select("pair_id", "source", "target"), "pairs")
    done = scratch_table(spark, RV.finalized(pairs, glossary), "reviewed")
    checked = pairs.select("pair_id", "source").join(done.select("pair_id", F.col("text").alias("target")), "pair_id")
    return done.select("pair_id", "text").join(RV.report(checked, glossary).select("pair_id", "score", "issue_count"), "pair_id")


@dataclass(frozen=True)
class Routed:
    """Several models as one: a prompt begins with the name of the one that it is for."""

    models: dict[str, Backend]

    def generate(self, prompt: str, attempt: int) -> str:
        name, _, rest = prompt.partition(ROUTE)
        return self.models[name].generate(rest, attempt)


ROUTE = "\x1f"


def _routed(prompt: Column) -> Column:
    return F.concat(F.col("model"), F.lit(ROUTE), prompt)


def grid(spark: SparkSession, docs: DataFrame, translators: dict[str, Backend], refiners: dict[str, Backend] | None = None, language: str = "en", config: Config | None = None, calls: Calls | None = None) -> DataFrame:
    """(doc_id, model, refiner, source, target, status, seconds): each text by each translator, and each translation by each refiner.

    The model is a column: one job asks all translators, and one all refiners; a translation is made once and crossed
    with the refiners.  refiner is null where a translation stands alone.  seconds are those of the calls, both steps';
    status is ok if all calls had answers.  Scores are ``scored``'s, ranks ``ordered.bench_rank``'s.
    """
    config = config or Config()
    names = lambda models: F.explode(F.array(*[F.lit(m) for m in models]))
    chunks = K.chunk_strict(docs, config.translate_chunk_chars).select("doc_id", "chunk_idx", "text").withColumn("model", names(translators))
    asked = ask(spark, chunks, _routed(prompts.translation(F.col("text"), None, None, T.classify_chunk(F.col("text")), language)), Routed(translators), ok=filled, calls=calls)
    answer = W.drop_marker_lines(F.coalesce(W.between_markers(F.coalesce("answer", "text")), F.col("text")))
    output = W.postprocess_translation(RP.guarded(F.col("text"), answer, answer, "translate"), F.col("text"))
    parts = asked.select("doc_id", "chunk_idx", "model", F.lit(None).cast("string").alias("refiner"), output.alias("output"), "status", "seconds")
    whole = scratch_table(spark, _whole(parts), "grid-translated")
    if not refiners:
        return whole.join(docs.select("doc_id", F.col("text").alias("source")), "doc_id").select("doc_id", "model", "refiner", "source", "target", "status", "seconds")
    crossed = scratch_table(spark, whole.withColumn("refiner", names(refiners)).withColumn("row", F.monotonically_increasing_id()), "grid-crossed")
    again = K.chunk_strict(crossed.select(F.col("row").alias("doc_id"), F.col("target").alias("text")), config.refine_chunk_chars).withColumnRenamed("doc_id", "row")
    again = again.join(crossed.select("row", "doc_id", F.col("model").alias("translator"), "refiner"), "row").withColumn("model", F.col("refiner"))
    asked = ask(spark, again, _routed(prompts.refinement(F.col("text"), None, language)), Routed(refiners), ok=filled, calls=calls)
    parsed = rewritten(asked.withColumn("given", F.coalesce("answer", F.lit(""))), lambda t: (prose.sanitized_refinement(t), 0), ["none"], ("given",), "clean").drop("none")
    judged = parsed.withColumn("r", RP.refined_chunk(F.col("text"), RP.guarded(F.col("text"), F.col("given"), F.col("clean"))))
    better = F.when(F.col("r.ok") & (F.col("r.text") != ""), F.col("r.text")).otherwise(F.col("text"))
    parts = judged.select("doc_id", "chunk_idx", F.col("translator").alias("model"), "refiner", better.alias("output"), "status", "seconds")
    first = whole.select("doc_id", "model", F.col("seconds").alias("before"), F.col("status").alias("first_status"))
    both = _whole(parts).join(first, ["doc_id", "model"]).withColumns({"seconds": F.col("seconds") + F.col("before"), "status": F.when(F.col("first_status") == "ok", F.col("status")).otherwise("failed")})
    both = scratch_table(spark, both.select(whole.columns), "grid-refined")
    out = whole.union(both).join(docs.select("doc_id", F.col("text").alias("source")), "doc_id")
    return out.select("doc_id", "model", "refiner", "source", "target", "status", "seconds")


def _whole(parts: DataFrame) -> DataFrame:
    texts = F.array_sort(F.collect_list(F.struct("chunk_idx", "output")))
    status = F.when(F.count_if(F.col("status") != "ok") == 0, "ok").otherwise("failed")
    return parts.groupBy("doc_id", "model", "refiner").agg(F.array_join(F.transform(texts, lambda p: p["output"]), "\n\n").alias("target"), status.alias("status"), F.sum("seconds").alias("seconds"))


def scored(spark: SparkSession, rows: DataFrame, glossary: DataFrame) -> DataFrame:
    """``rows`` of ``grid`` with score, by the quality checks of each pair of texts."""
    named = scratch_table(spark, rows.withColumn("pair_id", F.concat_ws(ROUTE, "doc_id", "model", F.coalesce("refiner", F.lit("")))), "grid-rows")
    return named.join(RV.report(named.select("pair_id", "source", "target"), glossary).select("pair_id", "score"), "pair_id").drop("pair_id")
