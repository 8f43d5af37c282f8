"""UX-03..06: steps that a model may take part in. A step is a function of a DataFrame; without a model it has a fixed answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsight.functions import scalars as S

#: Asks a model for a batch of prompts; answers are JSON text, None where there is none.
Model = Callable[[list[str]], list[str | None]]


@dataclass(frozen=True)
class Step:
    """UX-03: a named step. ``needs`` are the columns it reads; one that is missing is an error before anything runs."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()


@dataclass
class Outcome:
    """What steps made, how far they came, and why they ended there."""

    rows: DataFrame
    done: list[str] = field(default_factory=list)
    error: str | None = None

    @property
    def success(self) -> bool:
        return self.error is None


def execute(steps: list[Step], rows: DataFrame) -> Outcome:
    """UX-03: the steps one after the other, as one plan; the first that cannot be planned ends them."""
    out = Outcome(rows)
    for step in steps:
        missing = [c for c in step.needs if c not in out.rows.columns]
        if missing:
            out.error = f"{step.name}: no column {', '.join(missing)}"
            return out
        out.rows = out.rows.transform(step.run)
        out.done.append(step.name)
    return out


def asked(df: DataFrame, prompt: Column, model: Model, batch: int = 64, out: str = "answer") -> DataFrame:
    """``df`` with a model's answers, asked in batches within tasks. A batch whose call fails has none."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            prompts, answers = rows.column("__prompt").to_pylist(), []
            for at in range(0, len(prompts), batch):
                part = prompts[at : at + batch]
                try:
                    found = model(part)
                except Exception:
                    found = [None] * len(part)
                answers += [*found, *[None] * (len(part) - len(found))][: len(part)]
            kept = [k for k, n in enumerate(rows.schema.names) if n != "__prompt"]
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in kept), pa.array(answers, pa.string())], [*(rows.schema.names[k] for k in kept), out])

    return df.withColumn("__prompt", prompt).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


#: What a cleaning answer holds.
CLEANING = "summary string, topics array<string>, sentiment string, noise boolean"
SENTIMENTS = ("positive", "negative", "neutral")


def cleaning(df: DataFrame, model: Model | None = None, title: str = "title", desc: str = "desc", keyword: str = "keyword") -> DataFrame:
    """UX-04: ``summary, topics, sentiment, noise`` of every record.

    A model is told title, text and keyword and answers JSON; what is no such JSON, or a sentiment that is none, falls
    back field by field to the answer without a model: the first 150 letters, the keyword, hint words, no noise.
    """
    summary, mood = S.analysis(F.col(title), F.col(desc), F.col(keyword))
    own = {"summary": summary, "topics": F.array(F.col(keyword)), "sentiment": mood, "noise": F.lit(False)}
    if model is None:
        return df.withColumns(own)
    part = lambda c, n: F.left(F.coalesce(F.col(c), F.lit("")), F.lit(n))
    prompt = F.concat_ws("\n", part(title, 500), part(desc, 1000), part(keyword, 500))
    told = asked(df, prompt, model).withColumn("answer", F.from_json(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), CLEANING))
    found = {c: F.col(f"answer.{c}") for c in own}
    found["sentiment"] = F.when(found["sentiment"].isin(*SENTIMENTS), found["sentiment"])
    found["summary"] = S.filled(found["summary"])
    return told.withColumns({c: F.coalesce(found[c], own[c]) for c in own}).drop("answer")


def supplements(df: DataFrame, model: Model | None = None, template: str = "{keyword}", most: int = 2, out: str = "supplements") -> DataFrame:
    """UX-05: up to ``most`` search words that a model adds to a keyword, none without a model. ``template`` names columns in braces."""
    if model is None:
        return df.withColumn(out, F.array().cast("array<string>"))
    prompt = F.lit(template)
    for c in df.columns:
        prompt = F.replace(prompt, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    words = F.from_json(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), "expanded_keywords array<string>")["expanded_keywords"]
    kept = F.slice(F.array_distinct(F.filter(F.transform(words, S.strip), lambda w: w != "")), 1, most)
    return asked(df, prompt, model).withColumn(out, F.coalesce(kept, F.array().cast("array<string>"))).drop("answer")


def section(text: Column, marker: str = "### System Prompt", fallback: str = "") -> Column:
    """UX-06: of Markdown, the first code block behind a marker, else what stands up to the next section; a fallback where that is blank."""
    after = F.when(F.contains(text, F.lit(marker)), F.regexp_replace(text, rf"(?s)\A.*?{_quoted(marker)}", ""))
    block = F.regexp_extract(after, r"(?s)```[^\n]*\n(.*?)(?:```|\z)", 1)
    plain = F.regexp_extract(after, r"(?s)\A(.*?)(?:\n## |\z)", 1)
    return F.coalesce(S.filled(F.when(F.contains(after, F.lit("```")), block).otherwise(plain)), F.lit(fallback))


def _quoted(text: str) -> str:
    return rf"\Q{text}\E"
