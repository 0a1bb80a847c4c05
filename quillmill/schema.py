"""Row schemas and fixed values that all modules share."""

from __future__ import annotations

from pyspark.sql import types as T

ELEMENT = T.StructType(
    [
        T.StructField("element_id", T.StringType()),
        T.StructField("element_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("meta", T.StringType()),  # free-form, as JSON
    ]
)
PAGE = T.StructType(
    [
        T.StructField("page_number", T.IntegerType()),
        T.StructField("elements", T.ArrayType(ELEMENT)),
        T.StructField("raw_text", T.StringType()),
        T.StructField("has_image", T.BooleanType()),
        T.StructField("has_table", T.BooleanType()),
        T.StructField("meta", T.StringType()),
    ]
)
ERROR = T.StructType([T.StructField("kind", T.StringType()), T.StructField("message", T.StringType())])
TABLE_GRID = T.ArrayType(T.ArrayType(T.StringType()))

# Error kinds and exit codes of the protocol; the protocol's code is 4000 more.
EXIT_CODES = {
    "file_not_found": 2,
    "is_directory": 2,
    "permission_denied": 2,
    "unsupported_format": 3,
    "parse_failed": 4,
    "timeout": 5,
    "too_large": 6,
    "bad_request": 7,
    "internal": 70,
}

# Coarse type of each detected format.
FILE_TYPE = {
    "pdf": "pdf", "docx": "doc", "odt": "doc", "rtf": "doc", "epub": "doc", "eml": "txt", "msg": "txt", "pptx": "ppt", "odp": "ppt",
    "xlsx": "xls", "ods": "xls", "csv": "csv", "txt": "txt", "json": "txt", "yaml": "txt", "xml": "txt", "html": "txt", "toml": "txt",
    "srt": "txt", "latex": "txt", "sql": "txt", "svg": "image", "png": "image", "jpeg": "image", "gif": "image", "webp": "image", "bmp": "image", "tiff": "image",
}

MAX_BYTES = 100 * 1024 * 1024

# Words that a table's header is known by.
HEADER_WORDS = "id name title date time total sum price amount 编号 名称 标题 日期 时间 合计 总计 价格 数量 序号 项目 内容 备注 状态 类型 类别".split()
