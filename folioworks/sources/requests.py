"""Request bodies: JSON texts as documents, and those that are refused with the reason.

A body is parsed permissively.  What is no JSON object lands in a column of its own and
is refused as such; fields of another kind count as missing, and unknown ones are
ignored.  Each route has its own fields and codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import MIN_TEXT_CHARS
from ..functions.text import strip
from .adapters import page_confidence, page_text

PAGE = "struct<index:int,markdown:string,confidence_scores:struct<average_page_confidence_score:double>>"
#: Fields of the bodies of each route.
OCR_BODY = "ocrText string, userId string, projectId string, documentId string, source string, pageCount int, confidence double"
MARKDOWN_BODY = "text string, document_id string, user_id string, project_id string"
PAGES_BODY = f"ocr_response struct<pages:array<{PAGE}>>, document_id string, user_id string, project_id string"
#: Kept of every route.
FIELDS = ["document_id", "user_id", "project_id", "text", "source", "page_count", "confidence", "reject_code"]
_CORRUPT = "_corrupt"


def parsed(bodies: DataFrame, schema: str, column: str = "body") -> DataFrame:
    """``bodies`` with ``column`` parsed as ``request`` by ``schema``; ``request._corrupt`` holds what is no JSON object."""
    return bodies.withColumn("request", F.from_json(F.col(column), f"{schema}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))


def _empty(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


def _malformed(column: str) -> Column:
    body = F.ltrim(F.coalesce(F.col(column), F.lit("")))
    return F.col("request").isNull() | F.col(f"request.{_CORRUPT}").isNotNull() | ~body.startswith("{")


def _no_owner() -> Column:
    return _empty(F.col("request.user_id")) | _empty(F.col("request.project_id"))


def _route(bodies: DataFrame, columns: dict[str, Column], code: Column, column: str) -> DataFrame:
    known = {name: F.when(~_malformed(column), value) for name, value in columns.items()}
    return bodies.withColumns(known | {"reject_code": F.when(_malformed(column), "MALFORMED_BODY").otherwise(code)}).drop("request", column)


def ocr_requests(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Bodies of the OCR route as ``FIELDS`` (beside other columns); the source is ``pymupdf`` unless said."""
    rows, field = parsed(bodies, OCR_BODY, column), lambda name: F.col(f"request.{name}")
    text = F.coalesce(field("ocrText"), F.lit(""))
    code = F.when(strip(text) == "", "EMPTY_TEXT").when(F.length(text) < MIN_TEXT_CHARS, "TEXT_TOO_SHORT").when(_empty(field("userId")) | _empty(field("projectId")), "MISSING_OWNER")
    columns = {
        "document_id": field("documentId"), "user_id": field("userId"), "project_id": field("projectId"), "text": text,
        "source": F.coalesce(field("source"), F.lit("pymupdf")), "page_count": field("pageCount"), "confidence": field("confidence"),
    }
    return _route(rows, columns, code, column)


def markdown_requests(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Bodies of the markdown route.  White space alone is long enough for its own check, and fails later: a code of its own."""
    rows = parsed(bodies, MARKDOWN_BODY, column)
    text = F.coalesce("request.text", F.lit(""))
    code = F.when(F.length(text) < MIN_TEXT_CHARS, "TEXT_TOO_SHORT").when(_no_owner(), "MISSING_OWNER").when(strip(text) == "", "OCR_PROCESSING_ERROR")
    owner = {c: F.col(f"request.{c}") for c in ("document_id", "user_id", "project_id")}
    return _route(rows, owner | {"text": text, "source": F.lit("pymupdf"), "page_count": F.lit(None).cast("int"), "confidence": F.lit(None).cast("double")}, code, column)


def paged_requests(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Bodies of the route for OCR by page; pages are cleaned and joined before their length is checked."""
    rows = parsed(bodies, PAGES_BODY, column).withColumn("pages", F.coalesce("request.ocr_response.pages", F.array().cast(f"array<{PAGE}>")))
    rows = rows.withColumn("text", page_text(F.col("pages")))
    code = F.when(F.size("pages") == 0, "NO_PAGES").when(_no_owner(), "MISSING_OWNER").when(F.length("text") < MIN_TEXT_CHARS, "TEXT_TOO_SHORT")
    owner = {c: F.col(f"request.{c}") for c in ("document_id", "user_id", "project_id")}
    return _route(rows, owner | {"source": F.lit("mistral-ocr-3"), "page_count": F.size("pages"), "confidence": page_confidence(F.col("pages"))}, code, column).drop("pages")


def accepted(requests: DataFrame) -> DataFrame:
    """Requests that go on."""
    return requests.filter("reject_code IS NULL").drop("reject_code")


def refused(requests: DataFrame) -> DataFrame:
    """``document_id, reject_code`` of the others."""
    return requests.filter("reject_code IS NOT NULL").select("document_id", "reject_code")
