"""Annotation jobs: prompts in, structured labels out, in batches per rater with a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolytics.functions import text
from annolytics.operators.relational import cross_with_dimension
from annolytics.operators.windows import number_rows
from annolytics.session import materialize

RATER_SCHEMA = (
    "api string, model string, chat_function string, params map<string,string>, processing string, prompt_batch_size int"
)
TOKEN_COLUMNS = ("input_tokens", "output_tokens", "cached_input_tokens", "cost")
RESPONSE_SCHEMA = (
    "prompt_digest string, model string, response string, input_tokens double, output_tokens double, "
    "cached_input_tokens double, cost double, error string"
)

# (prompts, model, params) -> one dict per prompt, in order: "response" (JSON text) and, if known, token counts.
Scorer = Callable[[Sequence[str], str, Mapping[str, str]], Sequence[Mapping[str, object]]]


def prompts(items: DataFrame, template: str, slots: Mapping[str, Column]) -> DataFrame:
    """Add the rendered prompt and its digest."""
    return items.withColumn("prompt", text.render_template(template, slots)).withColumn(
        "prompt_digest", text.digest(F.col("prompt"))
    )


def _kept(raters: Sequence[Mapping], exclude: Sequence[str]) -> list[dict]:
    return [dict(r) for r in raters if r["model"] not in exclude]


def work_list(prompted: DataFrame, raters: Sequence[Mapping], exclude: Sequence[str] = ()) -> DataFrame:
    """Every distinct prompt, as its digest, for every rater, numbered into batches of the rater's own size.

    All raters get the same prompts in the same order, so the digests are numbered once and the raters come in by a
    generator. The texts stay where they are; :func:`score` gives the same batches their texts.
    """
    numbered = number_rows(prompted.select("prompt_digest").distinct(), ["prompt_digest"], name="_rn")
    crossed = cross_with_dimension(numbered, _kept(raters, exclude), RATER_SCHEMA)
    batch = (F.floor((F.col("_rn") - 1) / F.col("prompt_batch_size")) + 1).cast("long")
    return crossed.withColumn("batch", batch).drop("_rn")


def numbered_prompts(prompted: DataFrame, done: DataFrame | None = None, slices: int | None = None) -> DataFrame:
    """``prompt_digest, prompt, done, number``: distinct prompts in the order of their digests, stored in slices.

    The texts are shuffled once, into ranges of digests; stored results (``prompt_digest, model``) go the same way as rows
    without a text, so ``done``, the models that have answered a prompt, costs no join. Numbers count through all slices.
    """
    rows = prompted.select("prompt_digest", "prompt", F.lit(None).cast("string").alias("model"))
    if done is not None:
        rows = rows.unionByName(done.select("prompt_digest", F.lit(None).cast("string").alias("prompt"), "model"))
    slices = slices or int(prompted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a range of digests holds all rows of a digest, so the grouping needs no shuffle of its own
    distinct = rows.repartitionByRange(slices, "prompt_digest").groupBy("prompt_digest").agg(
        F.max("prompt").alias("prompt"), F.collect_set("model").alias("done")
    )
    laid = distinct.where(F.col("prompt").isNotNull()).sortWithinPartitions("prompt_digest")
    laid = materialize(
        laid.withColumn("_slice", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), "prompts"
    )
    spans = laid.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_start"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    number = (F.col("_before") + F.col("_place") - F.col("_start") + 1).cast("long")
    return laid.join(F.broadcast(spans), "_slice").select("prompt_digest", "prompt", "done", number.alias("number"))


def score(
    prompted: DataFrame, raters: Sequence[Mapping], scorer: Scorer, done: DataFrame | None = None,
    exclude: Sequence[str] = (), slices: int | None = None,
) -> DataFrame:
    """Answers of every rater to every distinct prompt; pairs (digest, model) listed in ``done`` are left out.

    A task streams over its slice of the prompts once and cuts it into the batches of all raters as it goes, holding one
    open batch for each. A batch that crosses the edge of a slice goes to the scorer in two calls, none larger than the
    rater's size. A failing call yields its rows with ``error`` set and no response; the others go on.
    """
    kept = [(r["model"], dict(r.get("params") or {}), int(r["prompt_batch_size"])) for r in _kept(raters, exclude)]

    def answered(model: str, params: dict, digests: list, texts: list) -> pa.RecordBatch:
        try:
            answers = list(scorer(texts, model, params))
            if len(answers) != len(texts):
                raise ValueError(f"scorer gave {len(answers)} answers for {len(texts)} prompts")
            error = None
        except Exception as problem:  # noqa: BLE001 - any scorer failure is this batch's result
            answers, error = [{}] * len(texts), f"{type(problem).__name__}: {problem}"
        n = len(digests)
        columns = [pa.array(digests, pa.string()), pa.array([model] * n), pa.array([a.get("response") for a in answers], pa.string())]
        columns += [pa.array([_number(a.get(c)) for a in answers], pa.float64()) for c in TOKEN_COLUMNS]
        names = ["prompt_digest", "model", "response", *TOKEN_COLUMNS, "error"]
        return pa.RecordBatch.from_arrays([*columns, pa.array([error] * n, pa.string())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = [(0, [], []) for _ in kept]
        for rows in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            for digest, prompt, finished, number in zip(*(c.to_pylist() for c in rows.columns)):
                for at, (model, params, size) in enumerate(kept):
                    if model in finished:
                        continue
                    batch, digests, texts = pending[at]
                    if batch != (own := (number - 1) // size + 1):
                        if digests:
                            yield answered(model, params, digests, texts)
                        pending[at] = batch, digests, texts = own, [], []
                    digests.append(digest)
                    texts.append(prompt)
        for (model, params, _), (_, digests, texts) in zip(kept, pending):
            if digests:
                yield answered(model, params, digests, texts)

    return numbered_prompts(prompted, done, slices).mapInArrow(run, RESPONSE_SCHEMA)


def _number(value: object) -> float | None:
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return None


def with_token_columns(df: DataFrame) -> DataFrame:
    """All four token columns, as doubles; absent or unreadable ones become null."""
    out = df
    for column in TOKEN_COLUMNS:
        value = F.col(column).try_cast("double") if column in df.columns else F.lit(None).cast("double")
        out = out.withColumn(column, value)
    return out


def parse_flag(df: DataFrame, response: str = "response") -> DataFrame:
    """Typed columns of a yes/no answer; a confidence outside [0, 1] counts as a bad answer."""
    parsed = F.from_json(response, "about_politics boolean, justification string, confidence_score double")
    out = df.withColumn("_p", parsed)
    confidence = F.col("_p.confidence_score")
    bad = F.col(response).isNotNull() & (
        F.col("_p.about_politics").isNull() | confidence.isNull() | ~confidence.between(0.0, 1.0)
    )
    return out.select(*df.columns, "_p.about_politics", "_p.justification", "_p.confidence_score", bad.alias("invalid"))


def parse_themes(df: DataFrame, allowed: Sequence[str], response: str = "response") -> DataFrame:
    """Theme list of an answer, valid with one to four labels that are all in the allowed set."""
    out = df.withColumn("themes", F.from_json(response, "themes array<string>")["themes"])
    listed = F.forall("themes", lambda t: t.isin(list(allowed)))
    valid = F.col("themes").isNotNull() & F.size("themes").between(1, 4) & listed
    return out.withColumn("invalid", ~F.coalesce(valid, F.lit(False)))


def combine(batches: Iterator[DataFrame] | Sequence[DataFrame]) -> DataFrame:
    out = None
    for part in batches:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def group_digest(df: DataFrame, group: str, order: Sequence[str], body: str, lines_per_part: int = 500) -> DataFrame:
    """Numbered, newline-joined texts of each group, in parts of bounded size.

    The parts of a group, in order and joined by newlines, are the whole digest; no group is gathered in one task.
    """
    lines = df.where(F.length(F.trim(body)) > 0).select(group, *[c for c in order if c != group], F.col(body).alias("_body"))
    numbered = number_rows(lines, [c for c in order if c != group], [group], "_rn")
    numbered = numbered.withColumn("part", (F.floor((F.col("_rn") - 1) / lines_per_part) + 1).cast("long"))
    line = F.struct(F.col("_rn"), F.concat(F.col("_rn").cast("string"), F.lit(". "), F.col("_body")).alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n")
    return numbered.groupBy(group, "part").agg(F.count(F.lit(1)).alias("lines"), joined.alias("digest"))


def markdown_table(dim: DataFrame, columns: Sequence[str], order: str, rows_per_part: int = 1000) -> DataFrame:
    """``part, table``: a dimension as Markdown; line breaks become blanks and bars are escaped.

    The first part has the head. Parts hold a bounded number of rows and, joined by newlines in order, are the whole table.
    """

    def cell(name: str) -> Column:
        return F.replace(F.regexp_replace(F.coalesce(F.col(name).cast("string"), F.lit("")), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))

    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    head = [(0, 1, "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |")]
    heads = dim.sparkSession.createDataFrame(head, "_rn long, part long, line string")
    lines = number_rows(dim.select(F.col(order).alias("_order"), row.alias("line")), ["_order", "line"], name="_rn")
    part = (F.floor((F.col("_rn") - 1) / rows_per_part) + 1).cast("long")
    lines = lines.select("_rn", part.alias("part"), "line").unionByName(heads)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_rn", "line"))), lambda x: x["line"])
    return lines.groupBy("part").agg(F.array_join(ordered, "\n").alias("table"))
