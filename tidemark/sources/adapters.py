"""Streams from clients that Spark has no connector for, through its Python data source interface.

A client is anything with ``poll(position, limit) -> (payloads, position)``: it gives the lines after a position and the
position after them. Positions are kept by the query's checkpoint, so lines are read again after a failure and none is
acknowledged before it is safe. A client's library is imported only when it is asked for.

    spark.dataSource.register(PolledSource)
    spark.readStream.format("polled").options(client="package.module:factory", limit=500, ..).load()
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

# Fixed value: how many messages one poll takes.
LIMIT = 500


def client_of(options: dict):
    """The client that ``client`` = "module:factory" makes from the other options."""
    module, _, factory = options["client"].partition(":")
    return getattr(importlib.import_module(module), factory)(options)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options, self.limit = options, int(options.get("limit", LIMIT))

    def initialOffset(self) -> dict:
        return {"position": json.dumps(client_of(self.options).start())}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        lines, position = client_of(self.options).poll(json.loads(start["position"]), self.limit)
        return iter([(x,) for x in lines]), {"position": json.dumps(position)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        client, at, stop = client_of(self.options), json.loads(start["position"]), json.loads(end["position"])
        while at != stop:
            lines, after = client.poll(at, self.limit)
            yield from ((x,) for x in lines)
            if after == at:
                return
            at = after


class PolledSource(DataSource):
    """(payload) lines of a polled client."""

    @classmethod
    def name(cls) -> str:
        return "polled"

    def schema(self) -> str:
        return "payload string"

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


class ListClient:
    """Lines of a JSON list file; for tests and replays."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def start(self) -> int:
        return 0

    def poll(self, position: int, limit: int) -> tuple[list[str], int]:
        with open(self.path) as f:
            lines = json.load(f)[position : position + limit]
        return lines, position + len(lines)


class RedisStreamClient:
    """Entries of a Redis stream from its beginning; payloads nested under ``data`` or flat."""

    def __init__(self, options: dict) -> None:
        redis = importlib.import_module("redis")
        self.key, self.redis = options["stream"], redis.Redis.from_url(options["url"], decode_responses=True)

    def start(self) -> str:
        return "0-0"

    def poll(self, position: str, limit: int) -> tuple[list[str], str]:
        entries = self.redis.xrange(self.key, min=f"({position}", count=limit)
        lines = [fields.get("data", json.dumps(fields)) for _, fields in entries]
        return lines, entries[-1][0] if entries else position


class KinesisClient:
    """Records of one shard, from the latest on."""

    def __init__(self, options: dict) -> None:
        self.client = importlib.import_module("boto3").client("kinesis", region_name=options.get("region"))
        self.stream, self.shard = options["stream"], options["shard"]

    def start(self) -> str:
        return ""

    def poll(self, position: str, limit: int) -> tuple[list[str], str]:
        after = {"ShardIteratorType": "AFTER_SEQUENCE_NUMBER", "StartingSequenceNumber": position} if position else {"ShardIteratorType": "LATEST"}
        at = self.client.get_shard_iterator(StreamName=self.stream, ShardId=self.shard, **after)["ShardIterator"]
        records = self.client.get_records(ShardIterator=at, Limit=limit)["Records"]
        return [r["Data"].decode() for r in records], records[-1]["SequenceNumber"] if records else position


class PubSubClient:
    """Messages of a Pub/Sub subscription.

    The service keeps no positions, so a position is the acknowledgements still owed: they are sent when the next poll
    begins, which is after the batch that holds the messages was planned. Messages that were not acknowledged come again.
    """

    def __init__(self, options: dict, client=None) -> None:
        self.client = client or importlib.import_module("google.cloud.pubsub_v1").SubscriberClient()
        self.path, self.timeout = options["subscription"], float(options.get("timeout", 1.0))

    def start(self) -> list[str]:
        return []

    def poll(self, position: list[str], limit: int) -> tuple[list[str], list[str]]:
        if position:
            self.client.acknowledge(request={"subscription": self.path, "ack_ids": position})
        found = self.client.pull(request={"subscription": self.path, "max_messages": limit}, timeout=self.timeout).received_messages
        return [m.message.data.decode("utf-8", "replace") for m in found], [m.ack_id for m in found]
