"""Line-first quality rules.

Each line is judged on its own: lines that are navigation, boilerplate, shouting, symbols or one word over and over, or
that do not end as a sentence does, are removed. A document is then rejected if too large a part of its words went with
them, or if the plain measures of the whole text (base_failed) fail.

Edge cases: null and empty texts have no words, fail the base and are not kept; blank lines are neither judged nor counted;
each repeated row gets its own result; a text of any length is one value of a bounded Arrow piece; an empty table gives no
rows; other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrow import pieces

MIN_WORDS = 50
#: A document is rejected if lines with more than this part of its words were removed.
MAX_LOST = 0.5
#: A line of more words is text even if its end is missing.
MAX_HEADING = 10
SYMBOLS = "#*$%&|<>"

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: White space to str.split, but not here.
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ENDS = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")", "]", "。", "！", "？", "؟", "।")
_BOILERPLATE = re.compile(
    r"\b(?:all rights reserved|licensed under|terms of (?:use|service)|privacy policy|cookie(?:s| policy)|subscribe (?:now|to)|sign (?:in|up)|log ?in|"
    r"powered by|copyright \d{4}|click here|read more|share (?:this|on)|enable javascript|lorem ipsum|"
    r"alle rechte vorbehalten|datenschutz(?:erklärung)?|impressum|nutzungsbedingungen|hier klicken|weiterlesen|jetzt anmelden|cookie-richtlinie|"
    r"tous droits réservés|politique de confidentialité|mentions légales|conditions d'utilisation|cliquez ici|lire la suite|se connecter|"
    r"todos los derechos reservados|política de privacidad|aviso legal|condiciones de uso|haga clic aquí|leer más|iniciar sesión)\b|©",
    re.IGNORECASE,
)


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text) if _OTHER_SPACE.search(text) else text.split()


def line_fails(line: str, words: list[str]) -> str:
    """Name of the first rule that a line with words fails, or ''."""
    n = len(words)
    if line.count("|") >= 2 and line.count("|") * 4 >= n:
        return "navigation"
    if sum(line.count(c) for c in SYMBOLS) * 5 >= n:
        return "symbols"
    if n >= 3 and line.count("!!") * 3 >= n:
        return "shouting"
    if n >= 10 and len(set(words)) * 4 <= n:
        return "repetition"
    if n <= 20 and _BOILERPLATE.search(line):
        return "boilerplate"
    if n <= MAX_HEADING and not words[-1].endswith(_ENDS):
        return "unfinished"
    return ""


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three words found at least twice."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    m = len(number)
    pair = ids[:-1] * m + ids[1:]
    if m > 2_000_000:  # m cubed would not fit
        pair, m_pair = np.unique(pair, return_inverse=True)[1], m
    else:
        m_pair = m
    _, which, counts = np.unique(pair[:-1] * m_pair + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[which] >= 2
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : k + len(twice)] |= twice
    return int(hit.sum())


def judge(text: str | None) -> dict:
    """All measures and the verdict for one text, and the text without the lines that failed."""
    text = text or ""
    words = words_of(text)
    lines, seen, dup, lost, kept_lines, failed = text.split("\n"), set(), 0, 0, [], 0
    for line in lines:
        own = words_of(line)
        if not own:
            kept_lines.append(line)
            continue
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        if line_fails(line, own):
            lost += len(own)
            failed += 1
        else:
            kept_lines.append(line)
    n, repeat = len(words), repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * repeat > 50 * n
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
        "base_failed": base_failed,
        "n_failed_lines": failed,
        "lost_words": lost,
        "kept": not base_failed and lost <= MAX_LOST * n,
        "cleaned": "\n".join(kept_lines),
    }


_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_failed_lines long, lost_words long, kept boolean"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cleaned: bool = False) -> DataFrame:
    """id, the measures and, if asked for, the cleaned text."""
    kind = docs.schema[id_col].dataType
    schema = f"id {kind.simpleString()}, {_MEASURES}" + (", cleaned string" if cleaned else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [judge(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[n] for r in rows]) for n in names[1:])], names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
