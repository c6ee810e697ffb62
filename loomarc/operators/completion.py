"""Model completion behind a replaceable client.

A client is a callable from a list of requests (dicts of the request columns) to a list of
answers. The replay client answers from a table, so everything is tested offline.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Client = Callable[[list[dict]], list[str | None]]


def complete(requests: DataFrame, client: Client, batch: int = 64) -> DataFrame:
    """Adds ``answer``; the client runs in Arrow batches on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                yield part.assign(answer=client(part.to_dict("records")))

    return requests.mapInPandas(run, T.StructType([*requests.schema, T.StructField("answer", T.StringType())]))


def replay(requests: DataFrame, recorded: DataFrame, *keys: str) -> DataFrame:
    """Answers from a recorded table; a request without one has null."""
    return requests.join(recorded.select(*keys, "answer"), list(keys), "left")


def chat_request(model: Column, prompt: Column, max_tokens: Column, image_url: Column | None = None) -> Column:
    """The JSON body of a chat completion request (not streamed, temperature 0)."""
    if image_url is None:
        content = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages")))
    else:
        parts = F.array(
            F.struct(F.lit("text").alias("type"), prompt.alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url")),
            F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(image_url.alias("url")).alias("image_url")),
        )
        content = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), parts.alias("content"))).alias("messages")))
    head = F.to_json(F.struct(model.alias("model"), max_tokens.alias("max_tokens"), F.lit(0).alias("temperature"), F.lit(False).alias("stream")))
    return F.concat(F.regexp_replace(head, r"\}$", ","), F.regexp_replace(content, r"^\{", ""))


def response_text(body: Column) -> Column:
    """The answer in a chat completion response."""
    return F.get_json_object(body, "$.choices[0].message.content")


def http_client(url: str, token: str, timeout: float = 120.0) -> Client:
    """A client that posts the ``body`` column; any error ends the task, which Spark retries."""

    def client(requests: list[dict]) -> list[str | None]:
        answers = []
        for request in requests:
            call = urllib.request.Request(url, request["body"].encode(), {"Authorization": f"Bearer {token}", "Content-Type": "application/json"})
            with urllib.request.urlopen(call, timeout=timeout) as response:
                answers.append(json.load(response)["choices"][0]["message"]["content"])
        return answers

    return client
