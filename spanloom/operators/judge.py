"""Judges: who decides whether a source supplied what a span says."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACING_S, MOST_RETRIES, BACKOFF_S, MOST_BACKOFF_S = 4.5, 4, 4.0, 40.0
AFTER_S = 0.5  # beyond the delay that a server names


class Judge(Protocol):
    available: bool

    def verdicts(self, pairs: DataFrame) -> DataFrame:
        """Adds derived, evidence and judge_available to pairs with span_text and source_text."""


def prompt(span: str, source: str) -> str:
    return (
        "Does the text under B state a specific value, rule or interface that it took from the text under A? "
        "A shared topic is not enough, nor is a helper that any program could have; an implementation of a rule in A is. "
        'Answer with one JSON object and nothing else: {"derived": true or false, "evidence": "the sentence of A, or empty"}\n\n'
        f"A:\n{source}\n\nB:\n{span}\n"
    )


class NoJudge:
    """Nothing is derived, and no judge is available."""

    available = False

    def verdicts(self, pairs: DataFrame) -> DataFrame:
        return pairs.withColumns({"derived": F.lit(False), "evidence": F.lit(""), "judge_available": F.lit(False)})


class ColumnJudge:
    """A judge that is an expression over the pairs' columns (for oracles and tests)."""

    available = True

    def __init__(self, derived, evidence=None):
        self.derived, self.evidence = derived, evidence

    def verdicts(self, pairs: DataFrame) -> DataFrame:
        evidence = self.evidence if self.evidence is not None else F.lit("")
        return pairs.withColumns({"derived": self.derived, "evidence": evidence, "judge_available": F.lit(True)})


SERVICE, SPACING = "SPANLOOM_JUDGE", "SPANLOOM_JUDGE_SPACING_MS"  # of the environment


def choose(transports: dict[str, Callable[[str], str]], forced: str | None = None, **options) -> Judge:
    """The judge of the forced service (the argument, else the environment's), else of the first one there is; without any, none
    is available. The environment's spacing counts unless one is given."""
    name = forced if forced is not None else os.environ.get(SERVICE) or next(iter(transports), None)
    if "spacing" not in options and os.environ.get(SPACING, "").isdigit():
        options["spacing"] = int(os.environ[SPACING]) / 1000
    return CallableJudge(transports[name], **options) if name in transports else NoJudge()


class RateLimited(Exception):
    """Raised by a transport that should be asked again; ``after`` seconds, if the server says so."""

    def __init__(self, after: float | None = None, daily: bool = False):
        super().__init__("rate limited")
        self.after, self.daily = after, daily


def parse_reply(reply: str) -> tuple[bool, str]:
    found = re.search(r"\{.*\}", reply, re.S)
    try:
        body = json.loads(found[0]) if found else {}
    except ValueError:
        body = {}
    body = body if isinstance(body, dict) else {}
    evidence = body.get("evidence")
    return body.get("derived") is True, evidence if isinstance(evidence, str) else ""


def ask(transport: Callable[[str], str], question: str, sleep: Callable[[float], None] = time.sleep) -> tuple[bool, str, bool]:
    """One verdict, with retries; a daily quota or any other error is an unavailable judge."""
    for attempt in range(MOST_RETRIES + 1):
        try:
            return (*parse_reply(transport(question)), True)
        except RateLimited as limit:
            if limit.daily or attempt == MOST_RETRIES:
                break
            backoff = min(2**attempt * BACKOFF_S, MOST_BACKOFF_S)
            sleep(backoff if limit.after is None else max(backoff, limit.after + AFTER_S))
        except Exception:
            break
    return False, "", False


class CallableJudge:
    """A judge behind a transport. One partition keeps a rate-limited service's spacing."""

    available = True

    def __init__(self, transport: Callable[[str], str], spacing: float = SPACING_S, partitions: int = 1):
        self.transport, self.spacing, self.partitions = transport, spacing, partitions

    def verdicts(self, pairs: DataFrame) -> DataFrame:
        transport, spacing = self.transport, self.spacing

        def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            free = 0.0
            for frame in frames:
                out = []
                for span, source in zip(frame["span_text"], frame["source_text"], strict=True):
                    time.sleep(max(0.0, free - time.monotonic()))
                    free = time.monotonic() + spacing
                    out.append(ask(transport, prompt(span, source)))
                yield frame.assign(derived=[d for d, _, _ in out], evidence=[e for _, e, _ in out], judge_available=[a for _, _, a in out])

        kinds = {"derived": T.BooleanType(), "evidence": T.StringType(), "judge_available": T.BooleanType()}
        schema = T.StructType([*pairs.schema.fields, *(T.StructField(n, t) for n, t in kinds.items())])
        return pairs.repartition(self.partitions).mapInPandas(judge, schema)
