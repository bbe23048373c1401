"""Line-first quality rules.

Base figures of a text reject it at once: fewer than 10 words, or over a fifth of its words in repeated 5-word
windows. Other texts are cleaned line by line. A line with words fails if it is
- boilerplate: a short line (12 words or fewer) holds a notice such as "accept cookies", "all rights reserved" or
  "subscribe to our newsletter", or half or more of it is a title such as "privacy policy" or "log in"; both in English,
  German, French and Spanish. A word such as cookies, copyright or newsletter alone is no sign,
- navigation: it has two or more separators such as | or >, which are a third or more of its words (a bullet or dash in
  front is none), or it is a link only,
- punctuation: a third or more of its characters other than white space are neither letters, digits nor common
  sentence marks, or a half or more of its words carry ! twice or a symbol of #*$%&|<>.
Failing lines are removed. A text that loses over half of its words this way is rejected; other texts are kept as
they are after cleaning.

Null texts count as empty and have no words. Ties do not arise: each row is judged by itself, so repeated rows get
equal results, and all columns of the input pass through unless a result's name replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.llm import arrays
from voxlake.llm.common import whole

MIN_WORDS, WINDOW, MAX_REPEATED, MAX_LOST = 10, 5, 20, 50
SYMBOLS = b"#*$%&|<>"

# what only notices say
_NOTICE = regex.compile(
    r"\b(accept (all )?cookies|(we|(this|our) (web)?site) uses? cookies|all rights reserved|copyright \d{4}|"
    r"(subscribe|sign up) (to|for) our \w+|(enable|requires?) javascript|javascript is (disabled|required)|click here|"
    r"(alle )?cookies (akzeptieren|zulassen)|(wir verwenden|diese (web)?seite verwendet) cookies|alle rechte vorbehalten|"
    r"abonnieren sie unseren newsletter|accepter (tous )?les cookies|(nous utilisons|ce site utilise) des cookies|"
    r"tous droits réservés|abonnez-vous à notre \w+|aceptar (todas )?las cookies|(utilizamos|este sitio utiliza) cookies|"
    r"todos los derechos reservados|suscríbe(te|se) a nuestr[oa] \w+)\b|\bcopyright (©|\(c\))|© ?\d{4}|lorem ipsum dolor")
# what a text may speak of as well
_TITLE = regex.compile(
    r"\b(privacy (policy|notice)|cookie (policy|settings)|terms (of|and) (use|service|conditions)|log ?in|sign ?(in|up)|"
    r"read more|share this|subscribe|newsletter|datenschutz(erklärung)?|impressum|nutzungsbedingungen|anmelden|weiterlesen|"
    r"politique de confidentialité|conditions d['’]utilisation|mentions légales|se connecter|lire la suite|"
    r"política de (privacidad|cookies)|términos (y condiciones|de uso)|aviso legal|iniciar sesión|leer más)\b")
_SEPARATORS = frozenset(("|", ">", "<", "»", "«", "•", "·", "/", "-", "–", "—", "*"))
_LINK = regex.compile(r"\s*(https?://|www\.)\S+\s*")
_ODD = regex.compile(r"[^\p{L}\p{M}\p{N}\s.,;:!?'\"()«»“”‘’¿¡\-–—]+")
_LOUD = regex.compile(r"!!|[#*$%&|<>]")

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_fails(line: str, words: list[str]) -> str | None:
    """The rule that a line with words fails."""
    n = len(words)
    if n <= 12:
        low = line.lower()
        if _NOTICE.search(low):
            return "boilerplate"
        titles = sum(len(m.group().replace(" ", "")) for m in _TITLE.finditer(low))
        if titles and 2 * titles >= sum(map(len, words)):
            return "boilerplate"
    between = sum(w in _SEPARATORS for w in words[1:])
    if between >= 2 and 3 * between >= n or _LINK.fullmatch(line):
        return "navigation"
    odd = sum(map(len, _ODD.findall(line)))
    if odd and 3 * odd >= sum(map(len, words)):
        return "punctuation"
    loud = _LOUD.search
    if n >= 3 and loud(line) and 2 * sum(loud(w) is not None for w in words) >= n:
        return "punctuation"
    return None


def repeated_words(raw: bytes) -> tuple[int, int]:
    """Words of a text, and those in windows that it has twice or more."""
    data = np.frombuffer(raw, np.uint8)
    start, end, _ = arrays.word_spans(data, np.array([0, len(data)]), arrays.is_space())
    n = len(start)
    if n <= WINDOW:
        return n, 0
    hashes = arrays.word_hashes(data, start, end)
    sums = arrays.prefix(hashes)
    at = np.arange(n - WINDOW + 1)
    windows = arrays.mix(arrays.span_hash(sums, at, at + WINDOW))
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(n - WINDOW + 2, np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    covered = np.zeros(n + 1, np.int64)
    covered[:len(twice) - 1] += twice[:-1]
    covered[WINDOW:WINDOW + len(twice) - 1] -= twice[:-1]
    return n, int(np.count_nonzero(np.cumsum(covered)[:n]))


_SPACE = bytes.maketrans(b"\t\x0b\x0c\r", b"    ")


def judge(text: str) -> tuple[list[int], bool, bool, str, int]:
    """Figures, base verdict, verdict, cleaned text and words lost of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    n_words, n_repeat = repeated_words(raw)
    plain = raw.translate(_SPACE)
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[str] = set()
    n_dup, lost, kept = 0, 0, []
    lines = text.split("\n")
    for line, flat in zip(lines, plain.decode("utf-8", "surrogatepass").split("\n"), strict=True):
        words = [w for w in flat.split(" ") if w]
        if words:
            n_dup += line in seen
            seen.add(line)
            if line_fails(line, words):
                lost += len(words)
                continue
        kept.append(line)
    base = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEATED * n_words
    return ([n_words, chars, n_symbols, n_dup, n_repeat], base, not base and 100 * lost <= MAX_LOST * n_words,
            "\n".join(kept), lost)


def _judged(text: str, passed: list[str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [judge(t) for t in part.column(text).to_pylist()]
            figures = list(zip(*(f[0] for f in found), strict=True)) or [()] * len(FIGURES)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(n) for n in passed), *(pa.array(x, pa.int64()) for x in figures),
                 *(pa.array([f[i] for f in found], pa.bool_()) for i in (1, 2)),
                 pa.array([f[3] for f in found], pa.string()), pa.array([f[4] for f in found], pa.int64())],
                names=[*passed, *FIGURES, "base_failed", "kept", "clean_text", "n_lost_words"])
    return run


def quality_rules(docs: DataFrame) -> DataFrame:
    """All columns of docs, the base figures, base_failed, kept, clean_text (failing lines removed) and n_lost_words."""
    new = {*FIGURES, "base_failed", "kept", "clean_text", "n_lost_words"}
    own = [c for c in docs.columns if c not in new]
    inner = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)), whole(F.col("text")).alias("judged"))
    passed = [f"c{i}" for i in range(len(own))]
    schema = T.StructType([inner.schema[c] for c in passed])
    for name in FIGURES:
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean").add("clean_text", "string").add("n_lost_words", "long")
    out = inner.mapInArrow(_judged("judged", passed), schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(own)), *FIGURES, "base_failed", "kept",
                      "clean_text", "n_lost_words")
