"""Enrichment of chunks by a language model: prompts, an injected client, repair of its JSON, merging."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import strip

LISTS = ("responsibilities", "inputs", "outputs", "side_effects", "failure_modes", "search_tags")
#: What each field of a reply is to hold; the form that replies are asked to have is made of them.
MEANING = {
    "description": "one or two sentences on the purpose of this code",
    "responsibilities": "a duty that it has",
    "inputs": "an argument, setting or piece of data that it reads",
    "outputs": "a value or change that it hands back or leaves behind",
    "side_effects": "something outside of it that it touches, such as a log, a network or a database",
    "failure_modes": "a way in which it may fail",
    "search_tags": "a word that someone looking for it may type",
}
FORM = json.dumps({k: v if k == "description" else [v] for k, v in MEANING.items()}, indent=1)
LABELS = (("responsibilities", "Responsibilities: "), ("search_tags", "Search tags: "), ("inputs", "Inputs: "), ("outputs", "Outputs: "), ("side_effects", "Side effects: "), ("failure_modes", "Failure modes: "))
Client = Callable[[str], str]


def prompts(chunks: DataFrame) -> DataFrame:
    """id, task, prompt: three tasks for each chunk of a symbol (with kind)."""
    head = F.lit("Return only valid JSON, without Markdown around it, in exactly this form:\n" + FORM + "\n\n")
    code = F.concat(F.lit("\n\nCode:\n```"), "language", F.lit("\n"), "content", F.lit("\n```\n"))
    about = F.concat(F.lit("\nFile: "), F.col("file_path"))
    lines = F.concat(F.lit("\nLines: "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    name = F.col("symbol_qualified_name")
    tasks = F.array(
        F.struct(F.lit("describe_symbol").alias("task"), F.concat(F.lit("This reply becomes part of an index of source code.\n"), head, F.lit("Task: describe_symbol\nSymbol: "), name, F.lit("\nKind: "), F.col("unit_type"), about, lines, code).alias("prompt")),
        F.struct(F.lit("summarize_function").alias("task"), F.concat(head, F.lit("Task: summarize_function\nFunction: "), name, about, code).alias("prompt")),
        F.struct(F.lit("generate_search_tags").alias("task"), F.concat(head, F.lit("Name terms that a developer might search for.\nTask: generate_search_tags\nSymbol: "), name, about, code).alias("prompt")),
    )
    return chunks.select("id", F.posexplode(tasks).alias("n", "t")).select("id", "n", "t.task", "t.prompt")


def complete(asked: DataFrame, make_client: Callable[[], Client]) -> DataFrame:
    """asked with reply: the client is made once in each worker; a reply is null where it failed."""

    @F.pandas_udf("string")
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make_client()

        def one(prompt: str) -> str | None:
            try:
                return client(prompt)
            except Exception:  # a model that fails must not end the run
                return None

        for part in parts:
            yield part.map(one)

    return asked.withColumn("reply", ask("prompt"))


def _strings(value: Column) -> Column:
    """A list of trimmed strings from a JSON value: a string is a list of one, anything else but a list is empty."""
    listed = F.from_json(value, "array<string>")
    single = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")
    items = F.when(strip(value).startswith("["), listed).when(strip(value).startswith('"'), single)
    return F.coalesce(F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def parse_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with description and the lists: the first that is a JSON object of a fenced object, the whole, the outermost braces."""
    text = strip(F.coalesce(F.col(reply), F.lit("")))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    is_object = lambda c: F.when(strip(c).startswith("{") & F.try_parse_json(c).isNotNull(), c)
    out = replies.withColumn("json", F.coalesce(is_object(fenced), is_object(text), is_object(braces)))
    get = lambda k: F.get_json_object("json", f"$.{k}")
    # get_json_object gives strings without their quotes, so a field is read again as it stands in a map
    raw = F.from_json("json", "map<string,string>")
    out = out.withColumn("raw", raw)
    field = lambda k: F.element_at("raw", F.lit(k))
    listed = lambda v: F.when(strip(v).startswith("["), v).otherwise(F.when(v.isNotNull() & ~strip(v).rlike(r"^(?:\{|-?\d|true$|false$|null$)"), F.to_json(F.array(v))))
    cols = {"description": strip(F.coalesce(get("description"), F.lit("")))}
    for k in LISTS:
        v = F.coalesce(field("search_tags"), field("tags")) if k == "search_tags" else field(k)
        cols[k] = _strings(listed(v))
    return out.withColumns(cols).drop("json", "raw")


def merge(parsed: DataFrame) -> DataFrame:
    """One profile for each id: the first description that isn't empty, lists united in order."""
    order = F.array_sort(F.collect_list(F.struct("n", "description", *LISTS)))
    by = parsed.groupBy("id").agg(order.alias("all"))
    first = F.element_at(F.filter(F.transform("all", lambda x: x["description"]), lambda d: d != ""), 1)
    first = F.when(F.size(F.filter("all", lambda x: x["description"] != "")) > 0, first).otherwise("")
    united = lambda k: F.array_distinct(F.flatten(F.transform("all", lambda x: x[k]))).alias(k)
    return by.select("id", first.alias("description"), *map(united, LISTS))


def profile_text() -> Column:
    """Lines of a profile; those without content are left out."""
    parts = [F.when(F.col("description") != "", F.col("description"))]
    parts += [F.when(F.size(k) > 0, F.concat(F.lit(label), F.array_join(k, ", "))) for k, label in LABELS]
    return F.concat_ws("\n", *parts)


def enrich(chunks: DataFrame, make_client: Callable[[], Client] | None) -> tuple[DataFrame, DataFrame | None]:
    """(chunks with profiles appended, enrichments); without a client chunks stay, and so do those whose profile is empty."""
    if make_client is None:
        return chunks, None
    merged = merge(parse_replies(complete(prompts(chunks.where("unit_type != 'file_summary'")), make_client))).withColumn("text", profile_text()).where("text != ''")
    out = chunks.join(merged.select("id", "text"), "id", "left")
    out = out.withColumn("profile", F.concat_ws("\n", "profile", "text")).drop("text")
    return out, merged.select(F.col("id").alias("chunk_id"), "description", "responsibilities", F.col("search_tags").alias("tags"), "inputs", "outputs", "side_effects", "failure_modes")


@dataclass
class ModelSettings:
    enabled: bool = False
    provider: str = "lmstudio"
    model: str = "local-model"
    base_url: str = "http://localhost:1234/v1"
    api_key: str = "lm-studio"
    temperature: float = 0.1
    max_tokens: int = 800
    timeout: float = 120.0


def http_client(s: ModelSettings) -> Callable[[], Client]:
    """A client of a chat-completions endpoint."""

    def make() -> Client:
        def ask(prompt: str) -> str:
            body = {"model": s.model, "messages": [{"role": "user", "content": prompt}], "temperature": s.temperature, "max_tokens": s.max_tokens}
            call = urllib.request.Request(s.base_url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {s.api_key}"})
            with urllib.request.urlopen(call, timeout=s.timeout) as r:
                return json.load(r)["choices"][0]["message"]["content"]

        return ask

    return make


def gateway_client(s: ModelSettings) -> Callable[[], Client]:
    """A client through a gateway library, looked up only when a worker needs it."""

    def make() -> Client:
        import importlib

        lib = importlib.import_module("litellm")
        prefix = {"ollama": "ollama/", "openai": "openai/"}.get(s.provider, "")
        name = s.model if s.model.startswith(prefix) else prefix + s.model
        return lambda prompt: lib.completion(model=name, messages=[{"role": "user", "content": prompt}], temperature=s.temperature, max_tokens=s.max_tokens, api_base=s.base_url)["choices"][0]["message"]["content"]

    return make


def client_for(s: ModelSettings) -> Callable[[], Client] | None:
    """None where enrichment is off."""
    return None if not s.enabled else http_client(s) if s.provider == "lmstudio" else gateway_client(s)
