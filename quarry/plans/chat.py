"""Prompts from search results, and a chat over them with a model that is passed in."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

EXCERPT_BYTES = 2000
OPENING = "Answer from the sources below and from nothing else. After each statement put the id of its source in square brackets."
CLOSING = "Where the sources do not settle the question, say what is missing."
NOTHING = "No source matches this question. Say so, and suggest other words or documents to add."
REWRITE = "Rewrite the question as search words that keep its meaning. Reply with these words alone."


class ChatModel(Protocol):
    def complete(self, system: str, message: str, temperature: float) -> str: ...


class HttpChatModel:
    """A client of a model server's ``/api/chat``."""

    def __init__(self, url: str = "http://localhost:11434", model: str = "gemma3:4b", timeout: float = 120):
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout

    def models(self) -> list[str]:
        """The names of the models that the server has."""
        with urllib.request.urlopen(f"{self.url}/api/tags", timeout=min(self.timeout, 10)) as got:
            return [m.get("name", "") for m in json.load(got).get("models", [])]

    def probe(self) -> dict:
        """Whether the server answers, and whether it has this model."""
        try:
            names = self.models()
        except (OSError, ValueError) as e:
            return {"reachable": False, "model": False, "error": str(e)}
        return {"reachable": True, "model": any(n == self.model or n.split(":")[0] == self.model for n in names), "models": names}

    def complete(self, system: str, message: str, temperature: float = 0.7) -> str:
        turns = [{"role": "system", "content": system}, {"role": "user", "content": message}]
        body = {"model": self.model, "messages": turns, "stream": False, "options": {"temperature": temperature, "top_p": 0.9}}
        request = urllib.request.Request(f"{self.url}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as got:
            text = json.load(got).get("message", {}).get("content", "")
        if not text:
            raise ValueError("the model returned nothing")
        return text


def source_block(rank: Column, id_: Column, score: Column, text: Column) -> Column:
    share = F.format_string("%.1f", score * 100)
    return F.concat(F.lit("Source "), rank.cast("string"), F.lit(" ["), id_.cast("string"), F.lit("], relevance "), share, F.lit("%:\n"), T.truncate(text, EXCERPT_BYTES))


def prompts(results: DataFrame, group: str) -> DataFrame:
    """``(group, prompt)``: the prompt of each group of ``results(group, rank, id, score, text)``; groups have a search limit's rows."""
    blocks = results.select(group, F.struct("rank", source_block(F.col("rank"), F.col("id"), F.col("score"), F.col("text")).alias("b")).alias("s"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["b"]), "\n\n")
    return blocks.groupBy(group).agg(F.concat(F.lit(OPENING + "\n\n"), joined, F.lit("\n\n" + CLOSING)).alias("prompt"))


def prompt_for(results: DataFrame) -> str:
    made = prompts(results.withColumn("_all", F.lit(0)), "_all").first()
    return made.prompt if made else NOTHING


def answer(message: str, model: ChatModel, find: Callable[[str], DataFrame]) -> dict:
    """Rewrite the question, search, and answer; if rewriting fails, the question is searched as it is."""
    if not message:
        raise ValueError("the message is empty")
    try:
        query = model.complete(REWRITE, message, 0.3).strip() or message
    except (OSError, ValueError):
        query = message
    results = find(query)
    found = results.select("rank", "id", "score", "text").orderBy("rank").collect()
    prompt = prompt_for(results) if found else NOTHING
    reply = model.complete(prompt, message, 0.7)
    cited = results.sparkSession.range(1).select(T.citations(F.lit(reply))).first()[0]
    return {"response": reply, "query": query, "sources": [r.asDict() for r in found], "cited": [c for c in cited if c in {r.id for r in found}]}
