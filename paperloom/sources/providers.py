"""The boundary to hosted models: batches go out, failures come back as fallbacks.

A call is any function from a prompt to an answer; it is made on the workers, once a row,
and its client once a worker. No model is part of this library.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


class RateLimited(Exception):
    """The service asks to wait."""


class Refused(Exception):
    """The service doesn't let this client in; no later call will fare better."""


def answer(prompt: str, call: Callable[[str], str], wait: float = 15.0, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The answer, or None: one more try after a wait when the rate is limited, none after
    any other failure; a refusal is passed on."""
    for last in (False, True):
        try:
            return call(prompt)
        except Refused:
            raise
        except RateLimited:
            if last:
                return None
            sleep(wait)
        except Exception:
            return None
    return None


def answers(prompts: DataFrame, connect: Callable[[], Callable[[str], str]], wait: float = 15.0) -> DataFrame:
    """(key, raw) of prompts (key, prompt): raw is null where there is no answer, and for
    all rows of a task behind a refusal, so a fallback can take them."""
    def run(batches: Iterator[pd.DataFrame]):
        call = None
        for batch in batches:
            out = []
            for prompt in batch["prompt"]:
                try:
                    call = connect() if call is None else call
                    out.append(answer(prompt, call, wait) if call else None)
                except Refused:
                    call = False
                    out.append(None)
            yield pd.DataFrame({"key": batch["key"], "raw": out})

    return prompts.select("key", "prompt").mapInPandas(run, f"key {dict(prompts.dtypes)['key']}, raw string")


def pieces(text: str, size: int = 8) -> Iterator[str]:
    """An answer as a stream of pieces, for callers that show it as it comes."""
    for i in range(0, len(text), size):
        yield text[i : i + size]
