"""Agents: what decides which queries to ask and what a page is worth. Rules always do; a model's command-line tool may add to them.

A tool is any command that takes a prompt, in place of {prompt} or on its standard input, and prints an answer with JSON in it. A tool that
is missing, fails or talks without JSON changes nothing.
"""

from __future__ import annotations

import shlex
import shutil
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena import config
from verbena.operators import catalogues, classify, discover, facts, profile, relevance
from verbena.session import ship

#: Prompts are cut after so many characters, tools are stopped after so many seconds.
PROMPT_CHARACTERS, TOOL_SECONDS, MOST_QUERIES = 12_000, 180, 12
#: How many facts and types of one answer count.
MOST_FACTS, MOST_TYPES = 20, 5


def ask(command: str, prompt: str, seconds: int = TOOL_SECONDS) -> tuple[str | None, str | None]:
    """The last JSON that a tool answers, and why there is none."""
    words = shlex.split(command)
    given = "{prompt}" in command
    try:
        done = subprocess.run([w.replace("{prompt}", prompt) for w in words], input=None if given else prompt, capture_output=True, text=True, timeout=seconds, encoding="utf-8", errors="replace", check=False)
    except (OSError, subprocess.TimeoutExpired) as e:
        return None, f"{type(e).__name__}: {e}"
    if done.returncode and not done.stdout.strip():
        return None, f"exit {done.returncode}: {done.stderr.strip()[:300]}"
    answer = facts.last_json(done.stdout)
    return answer, None if answer else "no JSON in the answer"


def answers(prompts: DataFrame, command: str, seconds: int = TOOL_SECONDS, parallel: int = 4) -> DataFrame:
    """key, answer (JSON), error for each prompt (key, prompt), asked on the executors, so many at a time."""
    ship(prompts.sparkSession)
    kind = prompts.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [ask(command, p or "", seconds) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a for a, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], names=["key", "answer", "error"])

    cut = prompts.select("key", F.substring("prompt", 1, PROMPT_CHARACTERS).alias("prompt"))
    return cut.repartition(parallel, "key").mapInArrow(run, f"key {kind}, answer string, error string")


@dataclass
class RuleAgent:
    """Queries from templates, scores from terms, facts from patterns."""

    name: str = "rule_based"
    max_queries: int = 24

    def available(self) -> tuple[bool, str]:
        return True, ""

    def queries(self, terms: DataFrame) -> DataFrame:
        return discover.search_queries(terms, self.max_queries)

    def analyse(self, candidates: DataFrame, languages: DataFrame, terms: DataFrame) -> DataFrame:
        """candidate_id, score, reasons."""
        return relevance.score(candidates, languages, terms).select("candidate_id", "score", "reasons")

    def facts(self, texts: DataFrame, key: str, name: str) -> DataFrame:
        """key, grp, field, value, confidence, quote of texts (key, text)."""
        return facts.extract_facts(texts, key, name=name)

    def classify(self, resources: DataFrame, key: str = "resource_id") -> DataFrame:
        """key, type, confidence of resources: see classify.classify()."""
        return classify.classify(resources.sparkSession, resources, key)


@dataclass
class ToolAgent:
    """The rules, with what a tool adds: more queries, and a score that moves that of the rules by 25 at most."""

    name: str
    command: str
    rules: RuleAgent
    seconds: int = TOOL_SECONDS

    def available(self) -> tuple[bool, str]:
        tool = shlex.split(self.command)[0]
        return (True, "") if shutil.which(tool) else (False, f"{tool} is not on the path")

    def queries(self, terms: DataFrame) -> DataFrame:
        base = self.rules.queries(terms)
        asked = terms.groupBy("language_id").agg(F.first("name").alias("name"), F.array_join(F.sort_array(F.collect_set("term")), ", ").alias("names"))
        prompt = F.concat(F.lit(f"Propose up to {MOST_QUERIES} web searches for resources of the language "), "name", F.lit(" (also: "), "names", F.lit('). Answer only with JSON: [{"query": "..."}]'))
        got = answers(asked.select(F.col("language_id").alias("key"), prompt.alias("prompt")), self.command, self.seconds)
        more = got.select(F.col("key").alias("language_id"), F.posexplode(F.slice(F.from_json("answer", "array<struct<query:string>>"), 1, MOST_QUERIES)).alias("i", "q")).where("q.query <> ''")
        more = more.select("language_id", F.substring("q.query", 1, 200).alias("query"), F.lit(f"agent:{self.name}").alias("basis"), (F.col("i") + 1000).alias("rank"))
        new = more.join(base.select("language_id", F.lower("query").alias("known")), (more["query"].isNotNull()) & (F.lower(more["query"]) == F.col("known")) & (more["language_id"] == base["language_id"]), "left_anti")
        return base.unionByName(new.dropDuplicates(["language_id", "query"]))

    def analyse(self, candidates: DataFrame, languages: DataFrame, terms: DataFrame) -> DataFrame:
        scored = self.rules.analyse(candidates, languages, terms)
        named = candidates.join(languages.select("language_id", F.col("name").alias("language")), "language_id")
        prompt = F.concat(F.lit("Does this text relate to the language "), "language", F.lit('? Answer only with JSON: {"score": 0-100}. Text: '), F.substring("text", 1, 6000))
        got = answers(named.select(F.col("candidate_id").alias("key"), prompt.alias("prompt")), self.command, self.seconds)
        said = got.select(F.col("key").alias("candidate_id"), F.get_json_object("answer", "$.score").cast("int").alias("model_score"))
        both = catalogues.model_scores(scored.join(said, "candidate_id", "left"))
        return both.select("candidate_id", F.col("final").alias("score"), "reasons")

    def facts(self, texts: DataFrame, key: str, name: str) -> DataFrame:
        """The rules' facts and the tool's, of fields that a profile has; each of the tool's is sure by 0.5 unless it says how sure it is."""
        base = self.rules.facts(texts, key, name)
        known = [f"{f.grp}.{f.name}" for f in profile.fields()]
        prompt = F.concat(F.lit(f"Which facts does this text state about the language {name}? Fields: {', '.join(known)}. "), F.lit('Answer only with JSON: [{"group": "...", "field": "...", "value": ..., "confidence": 0-1, "quote": "..."}]. Text: '), F.substring("text", 1, 7000))
        got = answers(texts.select(F.col(key).alias("key"), prompt.alias("prompt")), self.command, self.seconds)
        said = got.select(F.col("key").alias(key), F.explode(F.slice(F.from_json("answer", "array<struct<group:string,field:string,value:string,confidence:double,quote:string>>"), 1, MOST_FACTS)).alias("f"))
        said = said.where(F.concat_ws(".", "f.group", "f.field").isin(*known) & (F.coalesce("f.value", F.lit("")) != ""))
        values = F.when(F.col("f.value").startswith("["), F.from_json("f.value", "array<string>")).otherwise(F.array("f.value"))
        sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("f.confidence", F.lit(0.5))))
        more = said.select(key, F.col("f.group").alias("grp"), "f.field", F.explode(values).alias("value"), sure.alias("confidence"), F.substring(F.coalesce("f.quote", F.lit("")), 1, facts.QUOTE).alias("quote"))
        return base.unionByName(more.where("value <> ''"))

    def classify(self, resources: DataFrame, key: str = "resource_id") -> DataFrame:
        """The rules' types and those that the tool names, each with the greatest confidence."""
        base = self.rules.classify(resources, key)
        prompt = F.concat(F.lit(f"Which types of language resource is this? Types: {', '.join(classify.TYPES)}. "), F.lit('Answer only with JSON: [{"type": "...", "confidence": 0-1}]. Format: '), F.coalesce("format", F.lit("")), F.lit(". Names: "), F.substring("words", 1, 4000))
        got = answers(resources.select(F.col(key).alias("key"), prompt.alias("prompt")), self.command, self.seconds)
        said = got.select(F.col("key").alias(key), F.explode(F.slice(F.from_json("answer", "array<struct<type:string,confidence:double>>"), 1, MOST_TYPES)).alias("t")).where(F.col("t.type").isin(*classify.TYPES))
        more = said.select(key, "t.type", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("t.confidence", F.lit(0.5)))).alias("confidence"))
        return base.unionByName(more).groupBy(key, "type").agg(F.max("confidence").alias("confidence"))


def build(settings: dict, known: dict[str, dict] | None = None) -> RuleAgent | ToolAgent:
    """The agent that settings name: provider (rule_based by default, or the name of a tool), max_queries, cli (a command of one's own)."""
    rules = RuleAgent(max_queries=int(settings.get("max_queries", 24)))
    provider = settings.get("provider") or rules.name
    if provider == rules.name:
        return rules
    entry = {**(known or {}).get(provider, {}), **(settings.get("cli") or {})}
    if not entry.get("command"):
        raise ValueError(f"unknown agent {provider}; known: {', '.join([rules.name, *(known or {})])}")
    return ToolAgent(provider, entry["command"], rules, int(entry.get("timeout", TOOL_SECONDS)))


def installed(known: dict[str, dict]) -> list[tuple[str, bool, str]]:
    """name, whether its command is there, what it is, for each known tool."""
    return [(n, shutil.which(shlex.split(e["command"])[0]) is not None, e.get("what", "")) for n, e in known.items()]


def choose(path: str, provider: str, known: dict[str, dict]) -> None:
    """Write the provider to a settings file; an unknown one is refused."""
    if provider != RuleAgent.name and provider not in known:
        raise ValueError(f"unknown agent {provider}")
    config.write_key(path, "agent", "provider", provider)
