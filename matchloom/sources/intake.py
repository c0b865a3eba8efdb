"""Polymorphic requests and the upload gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENGINES = {"1.0.0": "text", "2.0.0": "structured"}
TEXT_SCHEMA = "engineVersion string, cvText string, jobText string"
CV_SCHEMA = (
    "basics struct<name:string,email:string,phone:string,location:string,url:string,summary:string>, "
    "work array<struct<name:string,position:string,start:string,end:string,summary:string,highlights:array<string>>>, "
    "education array<struct<institution:string,area:string,study_type:string,start:string,end:string>>, "
    "skills array<struct<name:string,level:string>>, certificates array<struct<name:string,issuer:string>>"
)


def _struct(schema: str) -> str:
    return ",".join(part.strip().replace(" ", ":", 1) for part in schema.split(", "))


STRUCTURED_SCHEMA = (
    f"engineVersion string, cv struct<{_struct(CV_SCHEMA)}>, "
    "job struct<title:string,company:string,description:string,location:string,employmentType:string,requirements:array<string>>"
)


def parse_requests(df: DataFrame, json_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S3: ``(text requests, structured requests, rejected)`` by the ``engineVersion`` of the JSON.

    A missing, non-text or unknown version is rejected with a code, as is JSON that cannot be read.
    """
    raw = F.col(json_col)
    parsed = df.withColumn("_v", F.from_json(raw, "engineVersion string", {"mode": "PERMISSIVE"})["engineVersion"])
    quoted = raw.rlike(r'"engineVersion"\s*:\s*"')
    kind = F.create_map(*[F.lit(x) for p in ENGINES.items() for x in p])[F.col("_v")]
    code = (F.when(F.get_json_object(raw, "$").isNull(), "INVALID_JSON").when(F.col("_v").isNull() | ~quoted, "ENGINE_VERSION_MISSING")
            .when(kind.isNull(), "ENGINE_VERSION_UNKNOWN"))
    coded = parsed.withColumns({"_kind": kind, "error_code": code})
    good = coded.filter("error_code is null")

    def branch(name: str, schema: str) -> DataFrame:
        rows = good.filter(F.col("_kind") == name).withColumn("_r", F.from_json(raw, schema))
        return rows.select(*[c for c in df.columns if c != json_col], "_r.*")

    rejects = coded.filter("error_code is not null").select(*df.columns, "error_code")
    return branch("text", TEXT_SCHEMA), branch("structured", STRUCTURED_SCHEMA), rejects


MAX_BYTES = 5 * 1024 * 1024
PDF = "application/pdf"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def upload_error(length: Column, mime: Column, head: Column, name: Column) -> Column:
    """Code of the first violated intake rule; ``head`` is the first four bytes."""
    low = F.lower(F.trim(mime))
    magic = F.hex(head)
    return (
        F.when(length == 0, "VALIDATION_EMPTY").when(length > MAX_BYTES, "TOO_LARGE")
        .when(~F.coalesce(low.isin(PDF, DOCX), F.lit(False)), "UNSUPPORTED_MEDIA")
        .when(F.coalesce(F.length(name), F.lit(0)) == 0, "VALIDATION_NAME").when(F.length(name) > 255, "VALIDATION_NAME")
        .when((length < 4) | ((low == PDF) & (magic != "25504446")) | ((low == DOCX) & (magic != "504B0304")), "UNSUPPORTED_MIME"))


def audit_uploads(files: DataFrame, mime: Column | None = None) -> DataFrame:
    """``(path, ok, error_code)`` for rows of a ``binaryFile`` scan.

    Only the first bytes of the content leave the scan. Without a declared MIME it follows from the suffix.
    """
    name = F.element_at(F.split("path", "/"), -1)
    if mime is None:
        mime = F.when(F.lower(name).endswith(".pdf"), PDF).when(F.lower(name).endswith(".docx"), DOCX)
    code = upload_error(F.col("length"), mime, F.substring("content", 1, 4), name)
    return files.select("path", code.isNull().alias("ok"), code.alias("error_code"))
