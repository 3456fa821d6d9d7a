"""JSON output with the public names: empty optional fields are left out, a missing time is the zero time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays

ZERO_TIME = "0001-01-01T00:00:00Z"
#: Review fields that are left out when empty.
OPTIONAL = {"replyText", "version"}


def _time(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), r"\.?0*Z$", "Z"), F.lit(ZERO_TIME))


def review_json(reviews: DataFrame) -> DataFrame:
    """``json``: one document per review. NULL fields are not written, so optional empty texts become NULL."""
    names = {"id": "id", "userName": "user_name", "userImage": "user_image", "date": "date", "score": "score", "text": "text", "replyDate": "reply_date", "replyText": "reply_text", "version": "version", "thumbsUp": "thumbs_up", "url": "url"}
    fields = []
    for public, column in names.items():
        c = _time(F.col(column)) if column in ("date", "reply_date") else F.col(column)
        fields.append((F.nullif(c, F.lit("")) if public in OPTIONAL else c).alias(public))
    keep = [c for c in ("app_id", "page_no", "pos") if c in reviews.columns]
    return reviews.select(*keep, F.to_json(F.struct(*fields)).alias("json"))


def write_json_lines(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One document per line, in as many files as there are partitions."""
    documents.select("json").write.mode(mode).text(path)


def write_json_array(documents: DataFrame, path: str, name: str, day: str | None = None, mode: str = "append") -> None:
    """One indented array in the file ``<name>_<day>.json`` of the folder ``path``; the rows keep their order (see ``arrays``).

    ``day`` is today where it is not given (in UTC). ``overwrite`` replaces the file of that day; ``append`` refuses to.
    """
    documents.sparkSession.dataSource.register(arrays.JsonArray)
    options = {"path": path, "name": name} | ({"day": day} if day else {})
    documents.select("json").write.format(arrays.JsonArray.name()).options(**options).mode(mode).save()


def report_lines(report: DataFrame) -> DataFrame:
    """``app_id, line``: each row of ``analytics.report`` as one text of several lines."""
    shares = [F.format_string(f"    {k} star: %d (%.1f%%)", f"n{k}", f"percent{k}") for k in (5, 4, 3, 2, 1)]
    latest = [F.format_string("  Date: %s", F.coalesce(F.date_format("latest_date", "yyyy-MM-dd"), F.lit("0001-01-01"))), F.format_string("  Score: %d", "latest_score"), F.format_string("  User: %s", "latest_user"), F.format_string("  Text: %s", "latest_text")]
    head = [F.format_string("Reviews: %d", "n_reviews"), F.lit("Stats:"), F.format_string("  Average score: %.2f", "avg_score"), F.lit("  Score distribution:")]
    return report.select("app_id", F.concat_ws("\n", *head, *shares, F.lit("Latest review:"), *latest).alias("line"))
