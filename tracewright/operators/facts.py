"""Documents to facts: chunks, prompts, completions, normalised facts."""

from __future__ import annotations

import html.parser
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import fixed
from tracewright.functions.values import optional_double, strip
from tracewright.sources.logs import explode_objects, objects_in_reply

SKIPPED = {"script", "style", "noscript", "table", "sup"}
BREAKING = {"p", "li", "h1", "h2", "h3"}


class _Text(html.parser.HTMLParser):
    """Collects text outside skipped elements, with line breaks around blocks."""

    def __init__(self) -> None:
        super().__init__()
        self.skipping, self.found = 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skipping += tag in SKIPPED
        if tag in BREAKING:
            self.found.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        if tag in BREAKING:
            self.found.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skipping and (text := data.strip()):
            self.found.append(text)


def text_of_html(source: str | None) -> str:
    parser = _Text()
    parser.feed(source or "")
    return re.sub(r"\n\s*\n+", "\n\n", " ".join(parser.found))


def _texts_of_html(source: pd.Series) -> pd.Series:
    return source.map(text_of_html)


def html_text(c: Column) -> Column:
    """The text of a page, without scripts, styles, tables and notes. Arrow UDF around the standard parser."""
    return F.pandas_udf(_texts_of_html, "string")(c)


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Windows of size characters, each overlapping the one before; the first that reaches the end is the last."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(n > 0, F.transform(starts, lambda s: F.substr(text, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def explode_chunks(documents: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """documents with chunk_index and chunk, a row a chunk. White space is squeezed first."""
    squeezed = strip(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", " "))
    return documents.select("*", F.posexplode(chunks(squeezed, size, overlap)).alias("chunk_index", "chunk"))


def _families() -> str:
    """The relation names that the graph gives labels or typed edges, by what they say."""
    quantities = [p for p in fixed.PLATFORM_PREDICATES if p.endswith(("_KT", "_M", "_PROFILE"))]
    families = [
        ("names, kinds, and what tells one from another", fixed.OTHER_PREDICATES),
        ("variants and carriers", fixed.PLATFORM_OBJECT_PREDICATES),
        ("radars, emitters and how they work", fixed.SENSOR_PREDICATES),
        ("who uses it", [*fixed.OPERATOR_PREDICATES, *fixed.COUNTRY_PREDICATES]),
        ("where it is", fixed.LOCATION_PREDICATES),
        ("speeds and heights", quantities),
    ]
    known = {p for _, own in families for p in own}
    return "\n".join(f"- {what}: {', '.join(own)}" for what, own in [*families, ("equipment", [p for p in fixed.PLATFORM_PREDICATES if p not in known])])


def extraction_prompt(title: Column, kind: Column, locator: Column, chunk: Column) -> Column:
    """The request for facts from a chunk, as one JSON object. The relations it names are those that the graph knows."""
    head = f"""Read the text chunk and list what it states about platforms, sensors, emitters, operators, kinematics and places.

Form of the answer: one JSON object that a strict parser reads, with no text, fence or comment around it:
{{"facts":[{{"subject":"...","predicate":"UPPER_SNAKE_CASE","object":"...","evidence":"...","confidence":0.0}}]}}
With nothing to state, answer {{"facts":[]}}. Evidence is a short quotation or a close rendering. Confidence, from 0 to 1, says how plainly the chunk states the fact.

Relations, preferably:
{_families()}
Where none of them fits, name one as specific in the same style.

What to look for:
- Many small facts about all the subjects of the chunk rather than a few broad ones about the first; some 8 to 20 where it holds as many, fewer where it is thin.
- What ties a radar or emitter, under each of its names, to the types and variants that carry it, and these to their operators' countries, usual speeds and heights, and areas. Observations to be matched later hold an emitter's name, type and role, a position, heading, height and speed, a kind of target and how far it was classified.
- Limits: the highest speed is MAX_SPEED_KT, in knots where the chunk gives them; ceilings are SERVICE_CEILING_M or MAX_ALTITUDE_M, in metres where it gives them. Otherwise keep the unit in the object.

What to leave out:
- Anything the chunk does not support, repeats, and objects that say nothing.
- From an encyclopedia, operators, countries and bases that are not clearly given as present ones, such as under a heading of current operators. Former operators, histories, purchases, captions and summary boxes do not count.
- Platforms that are none: a platform moves or holds people, weapons or sensors. A radar, missile, subsystem or bare designation stays what it is, also where an aircraft carries it; only a carrier that the chunk names is a platform."""
    return F.concat(F.lit(head + "\n\nSource title: "), title, F.lit("\nSource type: "), kind, F.lit("\nSource locator: "), locator, F.lit("\n\nText chunk:\n"), chunk)


def completion_text(response: Column, message: Column, thinking: Column) -> Column:
    """The first of a completion's fields that is not blank, else empty."""
    return F.coalesce(*(F.when(strip(c) != "", c) for c in (response, message, thinking)), F.lit(""))


def facts_payload(replies: DataFrame, keys: list[str], reply: str = "reply") -> DataFrame:
    """keys and payload (VARIANT): the reply's first JSON object with facts, else its first object; none: no row.

    Reasoning in <think> tags goes; a fenced block is preferred to the text around it.
    """
    t = strip(F.regexp_replace(F.coalesce(F.col(reply), F.lit("")), r"(?is)<think>.*?</think>", ""))
    fence = r"(?is)```(?:json)?\s*(.*?)```"
    body = F.when(t.rlike(fence), strip(F.regexp_extract(t, fence, 1))).otherwise(t)
    found = explode_objects(replies.select(*keys, body.alias("_body")), "_body", objects_in_reply).withColumn("v", F.try_parse_json("object")).filter("v is not null")
    no_facts = F.try_variant_get("v", "$.facts", "variant").isNull()
    return found.groupBy(*keys).agg(F.min_by("object", F.struct(no_facts.alias("n"), F.col("nth"))).alias("o")).select(*keys, F.parse_json("o").alias("payload"))


def normalise_facts(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fact_index and the facts of payloads(keys, payload).

    Items that are no objects, lack a subject or object, or have a confidence that is no number are left out. Null texts
    read as None. Predicates are upper case words joined by underscores, RELATED_TO if empty; confidences are within 0
    to 1, of NaN 1.
    """
    items = F.try_variant_get("payload", "$.facts", "array<variant>")
    rows = payloads.select(*keys, F.posexplode(items).alias("fact_index", "f")).filter(F.startswith(F.schema_of_variant("f"), F.lit("OBJECT")))

    def text(name: str, missing: str) -> Column:
        got = F.try_variant_get("f", f"$.{name}", "variant")
        return F.when(got.isNull(), F.lit(missing)).when(F.is_variant_null(got), F.lit("None")).otherwise(F.coalesce(F.try_variant_get("f", f"$.{name}", "string"), F.to_json(got)))

    predicate = F.regexp_replace(F.regexp_replace(F.upper(text("predicate", "RELATED_TO")), "[^A-Z0-9_]+", "_"), "^_+|_+$", "")
    got = F.try_variant_get("f", "$.confidence", "variant")
    kind = F.schema_of_variant(got)
    number = F.when(kind == "BOOLEAN", F.try_variant_get("f", "$.confidence", "boolean").cast("int").cast("double")).otherwise(optional_double(F.try_variant_get("f", "$.confidence", "string")))
    confidence = F.when(got.isNull(), 0.0).when(F.isnan(number), 1.0).when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    out = rows.select(
        *keys,
        "fact_index",
        strip(text("subject", "")).alias("subject"),
        F.when(predicate == "", "RELATED_TO").otherwise(predicate).alias("predicate"),
        strip(text("object", "")).alias("object"),
        strip(text("evidence", "")).alias("evidence"),
        confidence.alias("confidence"),
    )
    return out.filter("subject <> '' and object <> '' and confidence is not null")


def extraction_counts(replies: DataFrame, keys: list[str], reply: str = "reply") -> DataFrame:
    """One row: replies, blank ones, those with a JSON object, items of their fact lists, facts, and items left out."""
    payloads = facts_payload(replies, keys, reply)
    items = payloads.select(F.coalesce(F.size(F.try_variant_get("payload", "$.facts", "array<variant>")), F.lit(0)).alias("n"))
    asked = replies.agg(F.count("*").alias("replies"), F.coalesce(F.sum((strip(F.coalesce(F.col(reply), F.lit(""))) == "").cast("long")), F.lit(0)).alias("blank"))
    listed = items.agg(F.count("*").alias("with_object"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"))
    kept = normalise_facts(payloads, keys).agg(F.count("*").alias("facts"))
    # Three single rows side by side.
    one = lambda df: df.withColumn("_one", F.lit(1))
    out = one(asked).join(one(listed), "_one").join(one(kept), "_one").drop("_one")
    return out.withColumn("left_out", F.col("items") - F.col("facts"))


def extract_facts(documents: DataFrame, completer: Callable[[list[str]], list[str]] | DataFrame, size: int, overlap: int) -> DataFrame:
    """Facts of documents(source_id, source_type, locator, title, text), with chunk_index and fact_index as their order.

    completer: a function of a list of prompts, or a table (source_id, chunk_index, reply) of completions.
    """
    pieces = explode_chunks(documents, size, overlap)
    asked = pieces.withColumn("prompt", extraction_prompt(F.col("title"), F.col("source_type"), F.col("locator"), F.col("chunk")))
    keys = ["source_id", "source_type", "locator", "chunk_index"]
    if isinstance(completer, DataFrame):
        replies = asked.join(completer.select("source_id", "chunk_index", "reply"), ["source_id", "chunk_index"])
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(reply=completer(b["prompt"].tolist()))

        replies = asked.select(*keys, "prompt").mapInPandas(run, "source_id string, source_type string, locator string, chunk_index int, prompt string, reply string")
    return normalise_facts(facts_payload(replies, keys), keys)


