"""User functions over rows: request handlers whose errors are a status, model inference by batches, request limits."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A request's limits in bytes, with KB and MB read as powers of 1024.
HEADER_BYTES, BODY_BYTES = 128 * 1024, 100 * 1024 * 1024


def respond(handler: Callable) -> Callable[[Column], Column]:
    """request -> struct(status, body): 200 and what ``handler`` gives, or 500 and null where it raises.

    What isn't a function is an error here, before any row is read.
    """
    if not callable(handler):
        raise TypeError("the handler isn't a function")

    def one(request):
        try:
            body = handler(request)
        except Exception:  # a handler's own failure is the row's answer
            return 500, None
        return 200, None if body is None else str(body)

    def run(requests: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in requests], columns=["status", "body"])

    return F.pandas_udf(run, "status int, body string")


def probe(fetch: Callable) -> Callable[[Column], Column]:
    """host -> body that ``fetch`` gives as (status code, body); null for a status beyond 2xx or where it raises."""

    def one(host):
        try:
            code, body = fetch(host)
        except Exception:  # no answer is an answer
            return None
        return body if 200 <= code < 300 else None

    return F.pandas_udf(lambda hosts: hosts.map(one), T.StringType())


def infer(load: Callable[[], Callable], return_type, batch_size: int = 1024) -> Callable[..., Column]:
    """``load`` gives a function from arrays to an array; it is called once for each worker, not for each batch."""
    return predict_batch_udf(load, return_type=return_type, batch_size=batch_size)


def broken_limit(header_bytes: Column, body_bytes: Column, most_header: int = HEADER_BYTES, most_body: int = BODY_BYTES) -> Column:
    """The first limit that a request breaks, 'headers' or 'body'; null if none."""
    return F.when(header_bytes > most_header, "headers").when(body_bytes > most_body, "body")
