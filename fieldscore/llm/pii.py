"""Personal information inside free text: found by a conditional random field, checked exactly, replaced by placeholders.

The model is trained on the driver from the small labelled table of `pii_examples` (its size is a parameter), stored,
shared with all tasks (its weights have a fixed size), and run over whole texts; nothing is shuffled. What the model marks is
then checked and cut exactly: an e-mail address has to be one, numbers lose the words around them.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscore.llm import crf, pii_examples
from fieldscore.llm.crf import Crf
from fieldscore.llm.pii_examples import ROWS, labelled_rows
from fieldscore.session import checkpoint_dir

KINDS = ["email", "phone", "id_number", "street_address", "person_name"]

_DASH = "\\-‐‑‒–—"
_DOT = r"(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?|\s+dot\s+)"
_EMAIL = re.compile(rf"[^\W_](?:[\w.+'’\-]|{_DOT}(?=\w+\s+at\s))*(?:\s?@\s?|\s?[(\[]\s?at\s?[)\]]\s?|\s+at\s+)(?:[\w\-]+{_DOT})+[^\W\d_]{{2,}}", re.I)
_PHONE = re.compile(rf"[+(]{{0,2}}\d[\d ()/.{_DASH}\xa0]*\d(?:,?\s?(?:ext\.?|extn\.?|x|extension|Durchwahl|poste|toestel)\s?\d{{1,6}})?", re.I)
_ID = re.compile(rf"(?<!\w)(?:[A-Z]{{1,3}}[ {_DASH}]?)?\d[\d .{_DASH}]*\d(?:[ {_DASH}]?[A-Z]\b(?: \d{{3}})?)?", re.I)
_PRICES = re.compile(r"\d+[.,]\d\d\s+\d+[.,]\d\d$")
# Words of family names that are printed in small letters.
PARTICLES = frozenset("van von de der den di da del della du des la le ten ter zu dos bin ibn al el".split())
_EDGE = " \t\r\n.,;:|\"'“”()<>"


def _around(rx: re.Pattern, text: str, a: int, b: int, reach: int) -> tuple[int, int] | None:
    """The match nearest to the marked part that overlaps it."""
    lo = max(0, a - reach)
    best = None
    for m in rx.finditer(text, lo, min(len(text), b + reach)):
        shared = min(b, m.end()) - max(a, m.start())
        if shared > 0 and (best is None or shared > best[0]):
            best = (shared, m.start(), m.end())
    return best and best[1:]


def checked(text: str, a: int, b: int, kind: str) -> list[tuple[int, int]]:
    """The exact parts of a marked span; none if it can't be of its kind."""
    if kind == "email":
        m = _around(_EMAIL, text, a, b, 64)
        return [m] if m else []
    if kind == "phone":
        m = _around(_PHONE, text, a, b, 12)
        s = text[m[0] : m[1]] if m else ""
        number = re.split(r"[ex,]", s, maxsplit=1, flags=re.I)[0]
        return [m] if m and 7 <= sum(c.isdigit() for c in number) <= 15 and "  " not in s and not _PRICES.match(s) else []
    if kind == "id_number":
        m = _around(_ID, text, a, b, 4)
        s = text[m[0] : m[1]] if m else ""
        if sum(c.isdigit() for c in s) < 6 or "  " in s or _PRICES.match(s):
            return []
        x, y = m
        if x < a and text[x].isalpha():  # a word before the number that the model left out
            x = next(i for i in range(x, y) if text[i].isdigit() or i >= a)
        return [(x, y)]
    while a < b and text[a] in _EDGE:
        a += 1
    while a < b and text[b - 1] in _EDGE:
        b -= 1
    s = text[a:b]
    if kind == "street_address":
        return [(a, b)] if any(c.isdigit() for c in s) and sum(c.isalpha() for c in s) > 3 else []
    lines = [(a + m.start(), a + m.end()) for m in re.finditer(r"[^\r\n]+", s)]
    if len(lines) > 1 and (whole := [x for x in lines if _is_name(text[x[0] : x[1]])]):
        return [_trimmed(text, *x) for x in whole]
    a, b = _cased(text, a, b)
    return [(a, b)] if _is_name(text[a:b]) else []


def _cased(text: str, a: int, b: int) -> tuple[int, int]:
    """A name with capitals begins and ends with a word that has one; particles may stand before or within."""
    words = [(a + m.start(), a + m.end()) for m in re.finditer(r"\S+", text[a:b])]
    has = [any(c.isupper() for c in text[x:y]) for x, y in words]
    if not any(has):
        return a, b
    first, last = has.index(True), len(has) - 1 - has[::-1].index(True)
    while first and text[slice(*words[first - 1])].lower() in PARTICLES:
        first -= 1
    return _trimmed(text, words[first][0], words[last][1])


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in _EDGE:
        a += 1
    while a < b and text[b - 1] in _EDGE:
        b -= 1
    return a, b


def _is_name(s: str) -> bool:
    words = re.findall(r"[^\W\d_]+", s)
    return len(words) >= 2 and bool(re.search(r"[\s.,]", s)) and not any(c.isdigit() for c in s) and max(map(len, words)) >= 2


@lru_cache(maxsize=2)
def trained_model(rows: int = ROWS, epochs: int = 8, seed: int = 11) -> Crf:
    """The model of the labelled table; the same parameters give the same model."""
    table = labelled_rows(rows, seed)
    return Crf(KINDS).fit([t for t, _ in table], [s for _, s in table], epochs=epochs)


_STORED: dict[str, Crf] = {}


def stored_model(spark: SparkSession, rows: int = ROWS, folder: str | None = None) -> Crf:
    """The model from ``folder`` (by default in the shared folder of the cluster), trained and written there if it isn't yet.

    Its name holds a digest of the code that makes and trains it, so that a changed table isn't answered by an old model.
    """
    digest = xxhash.xxh3_64_hexdigest("\n".join([str(rows), *(inspect.getsource(m) for m in (crf, pii_examples))]))
    path = f"{(folder or checkpoint_dir(spark)).rstrip('/')}/pii-model-{digest}"
    if path not in _STORED:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            _STORED[path] = Crf.from_bytes(bytes(spark.read.parquet(path).first()[0]))
        else:
            _STORED[path] = trained_model(rows)
            spark.createDataFrame([(bytearray(_STORED[path].to_bytes()),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return _STORED[path]


def find(model: Crf, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """The checked spans of each text, in order and not overlapping."""
    out = []
    for text, spans in zip(texts, model.decode(texts), strict=True):
        held: list[tuple[int, int, str]] = []
        for a, b, kind in spans:
            held += [(*m, kind) for m in checked(text, a, b, kind) if not held or m[0] >= held[-1][1]]
        out.append(held)
    return out


def _shared_model(df: DataFrame, rows: int):  # noqa: ANN202
    return df.sparkSession.sparkContext.broadcast(stored_model(df.sparkSession, rows))


def pii_values(docs: DataFrame, doc: str = "doc_id", text: str = "text", rows: int = ROWS) -> DataFrame:
    """(doc_id, pii_type, pii_text): one row per distinct value in a text, exactly as it stands there.

    Null and empty texts have none, null ids are kept as null ids, repeated rows of one id with one text give their
    values once each; an empty table gives an empty result. Columns beside the two named ones don't matter.
    """
    shared = _shared_model(docs, rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for b in batches:
            texts = [t or "" for t in b["text"]]
            ids, kinds, values = [], [], []
            for i, t, spans in zip(b["doc_id"], texts, find(model, texts), strict=True):
                for v, kind in dict.fromkeys((t[x:y], k) for x, y, k in spans):
                    ids.append(i if isinstance(i, str) else None)
                    kinds.append(kind)
                    values.append(v)
            yield pd.DataFrame({"doc_id": ids, "pii_type": kinds, "pii_text": values}, dtype=object)

    kind = dict(docs.dtypes)[doc]
    read = docs.select(F.col(doc).cast("string").alias("doc_id"), F.col(text).alias("text"))  # as text, ids with nulls keep all digits
    return read.mapInPandas(run, "doc_id string, pii_type string, pii_text string").withColumn("doc_id", F.col("doc_id").cast(kind))


def redacted(docs: DataFrame, text: str = "text", to: str = "redacted", rows: int = ROWS) -> DataFrame:
    """All rows and columns with the text's values replaced by [EMAIL], [PHONE], [ID_NUMBER], [STREET_ADDRESS] and
    [PERSON_NAME] in the column ``to`` (which replaces one of that name). Null stays null, the rest of the text as is."""
    shared = _shared_model(docs, rows)

    @F.pandas_udf("string")
    def replace(texts: pd.Series) -> pd.Series:
        model = shared.value
        plain = [t or "" for t in texts]
        out = []
        for t, p, spans in zip(texts, plain, find(model, plain), strict=True):
            at, parts = 0, []
            for a, b, kind in spans:
                parts += [p[at:a], f"[{kind.upper()}]"]
                at = b
            out.append(None if t is None else "".join([*parts, p[at:]]))
        return pd.Series(out)

    return docs.withColumn(to, replace(F.col(text)))
