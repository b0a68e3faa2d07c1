"""Text functions: tokens, normalisation, checksums, paths, languages. Columns in, columns out."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: Fixed value: a token is a run of letters, numbers and symbols.
TOKEN = r"[\p{L}\p{N}\p{S}]+"
#: Languages with an analyser of their own, by code.
ANALYSERS = {"ja": "ja", "jpn": "ja", "zh": "zh", "cmn": "zh", "ko": "ko", "kor": "ko", "th": "th", "tha": "th"}
DEFAULT_ANALYSER = "multilang"


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order; cut first, lower-cased then."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), F.lower)


def clean_word(text: Column) -> Column:
    """The tokens of a text as written, joined by one space."""
    return F.array_join(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), " ")


def is_token(text: Column) -> Column:
    return text.rlike(f"^{TOKEN}$")


def checksum(content: Column) -> Column:
    """Identity of a content; equal contents have equal checksums."""
    return F.sha2(content, 256)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]?[^/\\]*$", "")


def page_count(tool_output: Column) -> Column:
    """Pages that a document tool's output names; 1 if it names none."""
    n = F.regexp_extract(tool_output, r"(?m)^Pages:\s+(\d+)\s*$", 1)
    return F.when(n.try_cast("int") > 0, n.try_cast("int")).otherwise(F.lit(1))


#: Entities that pages hold, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, the commonest entities are read, white space collapses."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


_breaks = re.compile(r"[^\S\n]+|[\x00-\x09\x0b-\x1f\x7f-\x9f]+")


def normalize(text: str) -> str:
    """NFKC; runs of white space or control characters other than newline become one space; lines and the whole trimmed."""
    flat = unicodedata.normalize("NFKC", text)
    flat = re.sub(r" {2,}", " ", _breaks.sub(" ", flat))
    return "\n".join(line.strip() for line in flat.split("\n")).strip()


def _each(texts: pa.Array, f: Callable[[str], str | None]) -> pa.Array:
    """f of each text that is not null. One text at a time is a Python string; the rest stays UTF-8 bytes, each once."""
    data, ends, known = bytearray(), np.zeros(len(texts) + 1, np.int32), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        out = f(text.as_py()) if text.is_valid else None
        if out is not None:
            data += out.encode()
            known[i] = True
        ends[i + 1] = len(data)
    valid = pa.py_buffer(np.packbits(known, bitorder="little"))
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(data), valid)


@F.arrow_udf(StringType())
def normalize_text(texts: pa.Array) -> pa.Array:
    return _each(texts, normalize)


#: Frequent words by ISO 639-3 code.
STOP_WORDS = {
    "deu": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "eng": "the of and to in is that it for was on are as with be by at this have from or an not which but they his her you were",
    "fra": "de la le et les des en un du une que est pour qui dans par plus pas sur ne au ce il avec se sont son mais nous",
    "spa": "de la que el en y los del se las por un para con no una su al lo como más pero sus le ya este sí porque",
}
_STOPS = {lang: frozenset(words.split()) for lang, words in STOP_WORDS.items()}
_SCRIPTS = (("jpn", re.compile("[\u3040-\u30ff]")), ("kor", re.compile("[\uac00-\ud7af]")), ("tha", re.compile("[\u0e00-\u0e7f]")), ("cmn", re.compile("[\u4e00-\u9fff]")))
#: Texts of fewer UTF-8 bytes are not judged; the best language must lead by this share of the words.
MIN_BYTES, LEAD = 20, 0.03


def language_of(text: str) -> str | None:
    """ISO 639-3 code, or None if the text is short or the evidence weak."""
    text = text.strip()
    if len(text.encode()) < MIN_BYTES:
        return None
    for lang, script in _SCRIPTS:
        if 3 * len(script.findall(text)) > len(text):
            return lang
        if lang == "jpn" and script.search(text):
            return lang
    words = re.findall(r"\w+", text.lower())
    share = sorted(((sum(w in stops for w in words) / max(len(words), 1), lang) for lang, stops in _STOPS.items()), reverse=True)
    return share[0][1] if share[0][0] - share[1][0] >= LEAD else None


@F.arrow_udf(StringType())
def detect_language(texts: pa.Array) -> pa.Array:
    return _each(texts, language_of)


def analyser_for(lang: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ANALYSERS.items() for x in pair])
    return F.coalesce(F.element_at(known, lang), F.lit(DEFAULT_ANALYSER))


def _osa(a: str, b: str) -> int:
    """Edits between two words; two neighbours swapped is one edit, and no place is edited twice."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, rows[-2][j - 2] + 1)
            row.append(d)
        rows.append(row)
    return rows[-1][-1]


def edit_distance(word: str):
    """A column function: edits between a column of words and one word; meant for few words (see ``maybe_near``)."""

    @F.pandas_udf(IntegerType())
    def distance(words: pd.Series) -> pd.Series:
        return words.map(lambda w: _osa(w, word), na_action="ignore")

    return distance


def maybe_near(words: Column, word: str, distance: int) -> Column:
    """True for every word within so many edits of one word, and for few others: lengths, then edits without swaps.

    A swap is two edits without swaps, so twice the distance bounds them. All of it runs inside Spark.
    """
    close = F.abs(F.char_length(words) - len(word)) <= distance
    return close & (F.levenshtein(words, F.lit(word), 2 * distance) >= 0)


#: Analysers that tokenizer() knows by name; more can be registered.
_ANALYSERS = {DEFAULT_ANALYSER: tokens}


def register_tokenizer(name: str, analyse) -> None:
    """Makes a column function (text -> array of terms) known by a name."""
    _ANALYSERS[name] = analyse


def tokenizer(name: str):
    """The analyser of that name, or the default one."""
    return _ANALYSERS.get(name, _ANALYSERS[DEFAULT_ANALYSER])


#: What the exit codes of crashed workers mean.
EXIT_CODES = {
    0xC0000005: "ACCESS_VIOLATION (segfault)",
    0xC0000017: "NO_MEMORY — probable OOM",
    0xC000009A: "INSUFFICIENT_RESOURCES — probable OOM",
    0xC00000D5: "COMMITMENT_LIMIT — probable OOM",
    0xC000013A: "CONTROL_C_EXIT (user interrupted)",
    0xC0000142: "DLL_INIT_FAILED",
    0xC0000409: "STACK_BUFFER_OVERRUN",
}


def exit_code_name(code: int) -> str:
    """An exit code as the log shows it: codes with the high bit set are status codes, with their meaning if known."""
    bits = code & 0xFFFFFFFF
    if bits < 0x80000000:
        return f"exited({code})"
    return f"exited({' '.join(filter(None, (f'0x{bits:08X}', EXIT_CODES.get(bits))))})"


def uptime(seconds: float) -> str:
    whole = int(seconds)
    return f"{whole}s" if whole < 60 else f"{whole // 60}m{whole % 60:02}s"


def shares(sizes: list[int]) -> str:
    """Files of each worker, as the log shows them."""
    return "[" + "/".join(map(str, sizes)) + "]"
