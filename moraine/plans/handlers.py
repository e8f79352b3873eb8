"""User functions and limits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import handlers
from .registry import query, table


def shout(event_type):
    if event_type == "error":
        raise ValueError(event_type)
    return event_type.upper()


@query("SELECT event_id, cast(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS integer) AS status, CASE WHEN event_type <> 'error' THEN upper(event_type) END AS body FROM events")
def handler_status(spark, sf_dir):
    answer = handlers.respond(shout)(F.col("event_type")).alias("r")
    return table(spark, sf_dir, "events").select("event_id", answer).select("event_id", "r.status", "r.body")


def doubled():
    """A model with two inputs: twice the first plus the second."""
    return lambda a, b: 2 * a + b


@query("SELECT vec_id, 2 * cast(embedding[1] AS double) + label AS y FROM embeddings")
def model_inference(spark, sf_dir):
    predict = handlers.infer(doubled, T.DoubleType())
    return table(spark, sf_dir, "embeddings").select("vec_id", predict(F.element_at("embedding", 1).cast("double"), F.col("label").cast("double")).alias("y"))


@query("SELECT page_id, CASE WHEN strlen(url) > 40 THEN 'headers' WHEN strlen(html) > 1500 THEN 'body' END AS broken FROM pages")
def request_limits(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", handlers.broken_limit(F.octet_length("url"), F.octet_length("html"), 40, 1500).alias("broken"))
