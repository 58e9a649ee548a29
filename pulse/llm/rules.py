"""Line-first cleaning by rules (operator 5): bad lines go, then documents that lose too much."""

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
CONTINUATION = bytes(range(128, 192))  # bytes of a character after its first
#: Whole lines that are navigation or boilerplate, in lower case.
NAVIGATION = re.compile(
    rb"^\W*(home|menu|login|log in|sign (in|up)|register|search|next( page)?|previous( page)?|back to top|share( this)?|"
    rb"read more|click here|subscribe|contact( us)?|about( us)?|sitemap|skip to content|startseite|anmelden|suche|"
    rb"accueil|connexion|rechercher|inicio|buscar)(\W+(home|menu|login|search|about|contact|next|previous|share))*\W*$"
)
BOILERPLATE = re.compile(
    rb"(all rights reserved|cookie policy|privacy policy|terms (of (use|service)|and conditions)|enable javascript|"
    rb"lorem ipsum|powered by|copyright \(c\)|\xc2\xa9 ?\d{4})"
)
#: Marks that may close a line.
ENDS = tuple(mark.encode() for mark in ".!?:;,\"')]}…。！？”’»")


@dataclass(frozen=True)
class Limits:
    """Least words of a document, greatest percentage of words in repeated triples, and of words lost with their lines."""

    words: int = 50
    repeated: int = 50
    lost: int = 30
    line_symbols: float = 0.1  # of a line's bytes
    line_marks: float = 0.3
    open_words: int = 10  # a line of fewer words needs a closing mark


def line_verdict(line: bytes, words: list[bytes], seen: set[bytes], limits: Limits) -> str:
    """Empty for a good line, else the rule that it fails."""
    if line in seen and len(words) > 2:
        return "repeated"
    low = line.lower()
    if NAVIGATION.search(low):
        return "navigation"
    if len(words) <= 40 and BOILERPLATE.search(low):
        return "boilerplate"
    size = sum(map(len, words))
    symbols = len(line.translate(None, NOT_SYMBOLS))
    if symbols > limits.line_symbols * size or words.count(b"|") * 4 > len(words):
        return "symbols"
    marks = sum(line.count(mark) for mark in (b"!", b"?", b".", b",", b";", b":", b"-", b"_", b"="))
    if marks > limits.line_marks * size:
        return "punctuation"
    if len(words) > 5 and line.count(b"!") * 2 > len(words):
        return "punctuation"
    if len(words) > 5 and line.isupper():
        return "capitals"
    if len(words) < limits.open_words and not line.rstrip().endswith(ENDS):
        return "unclosed"
    return ""


def clean(text: str | None, limits: Limits = Limits()) -> dict:
    """Base counts of a whole text, its good lines, and the verdict."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    duplicates, lost, good, seen = 0, 0, [], set()
    for line in data.split(b"\n"):
        own = line.split()
        if not own:
            good.append(line)
            continue
        failed = line_verdict(line, own, seen, limits)
        duplicates += line in seen
        seen.add(line)
        if failed:
            lost += len(own)
        else:
            good.append(line)
    # Words in three-word windows that come twice or more.
    repeated = 0
    triples = [*zip(words, words[1:], words[2:])]
    if len(set(triples)) < len(triples):
        met, twice = set(), set()
        for triple in triples:
            (twice if triple in met else met).add(triple)
        upto = 0  # words before this are counted
        for at, triple in enumerate(triples):
            if triple in twice:
                repeated += at + 3 - max(at, upto)
                upto = at + 3
    failed = n < limits.words or 100 * repeated > limits.repeated * n
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)) - sum(len(word) - len(word.translate(None, CONTINUATION)) for word in words if not word.isascii()),
        "n_symbols": len(data.translate(None, NOT_SYMBOLS)),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeated,
        "base_failed": failed,
        "kept": not failed and 100 * lost <= limits.lost * n,
        "lost_words": lost,
        "cleaned": b"\n".join(good).decode(),
    }


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, lost_words long, cleaned string"
)


def clean_documents(docs: DataFrame, limits: Limits = Limits(), with_text: bool = True) -> DataFrame:
    """Counts, verdict and (if asked for) the cleaned whole text of each row of `docs` (doc_id, text; others are not read).

    Lines are judged first: a repeated line, navigation, boilerplate, too many symbols,
    marks or only capitals remove it, and so does a missing closing mark if the line is short,
    as headings and link titles are. Then a document goes that fails the base rules, or
    loses more than `limits.lost` percent of its words. A null or empty text has no
    words and is not kept. Repeated rows and null ids give a row each.
    """
    names = [part.split()[0] for part in SCHEMA.split(", ")][:None if with_text else -1]
    schema = SCHEMA if with_text else SCHEMA.rsplit(", ", 1)[0]

    def judge(batches):
        types = {"base_failed": pa.bool_(), "kept": pa.bool_(), "cleaned": pa.string()}
        for batch in batches:
            found = [clean(text, limits) for text in batch.column("text").to_pylist()]
            columns = [pa.array([f[name] for f in found], types.get(name, pa.int64())) for name in names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(judge, schema)
