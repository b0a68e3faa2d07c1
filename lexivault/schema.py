"""Table schemas."""

from pyspark.sql import types as T

SCHEMA_VERSION = 2


_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "float": T.FloatType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<int>": T.ArrayType(T.IntegerType())}


def _s(fields: str) -> T.StructType:
    """A schema from "name type, …"; needs no session, so workers can import it."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in fields.split(","))])


DOCUMENTS = _s("collection_id string, doc_id long, path string, content string, n_tokens int")
POSTINGS = _s("collection_id string, term string, doc_id long, tf int, doc_length int, positions array<int>")
POSITIONS = _s("doc_id long, word_offset int, page int, x_min float, y_min float, x_max float, y_max float, word_text string")
JOBS = _s(
    "id long, path string, checksum string, status string, ocr_flag boolean, error string, ocr_attempts int, ocr_error string,"
    " failed_ocr timestamp, language string, file_modified long, file_size long, duplicate_of long"
)
LISTING = _s("path string, file_modified long, file_size long")
EXTRACTED = T.StructType([*_s("path string, checksum string, ocr_flag boolean, text string, page_count int, error string"), T.StructField("words", T.ArrayType(_s("page int, x_min float, y_min float, x_max float, y_max float, word_text string")))])
COLLECTIONS = _s("id long, folder string, label string, data_dir string, doc_count long, last_indexed timestamp, created_at timestamp")
SETTINGS = _s("json string")
