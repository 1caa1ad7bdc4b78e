"""Text expressions and the query side of full-text search."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

STOP_WORDS = sorted(
    set(
        """a again all an and are as at be been but by can don each few for from further he here how i in is it just
        more most no not now of on once only or other over own same she should some such than that the then there these
        they this those to too under very was we were when where why will with you
        的 了 是 在 和 就 都 而 及 与 或 一个 没有 我们 你们 他们 什么 这个 那个 因为 所以""".split()
    )
)

_CANONICAL = {
    "api interface": ["api", "接口"],
    "artificial intelligence": ["ai", "人工智能"],
    "code": ["代码", "程序"],
    "database": ["db", "数据库"],
    "deep learning": ["dl", "深度"],
    "go": ["golang"],
    "javascript": ["js"],
    "large language model": ["llm", "模型"],
    "machine learning": ["ml", "学习", "机器"],
    "natural language processing": ["nlp", "自然", "语言"],
    "python": ["py"],
    "search": ["搜索", "检索"],
    "vector embedding": ["embed", "向量"],
}
#: Source term to canonical phrase.
SYNONYMS = {s: canonical for canonical, sources in _CANONICAL.items() for s in sources}

_WORDS = r"[\p{L}\p{N}_]+"


def expand(term: str) -> list[str]:
    """The terms that mean the same: canonical phrase, its sources, and the sources of the term."""
    out = []
    canonical = SYNONYMS.get(term)
    if canonical:
        out += [canonical, *_CANONICAL[canonical]]
    out += _CANONICAL.get(term, [])
    return [x for x in dict.fromkeys(out) if x != term]


def words(text: Column) -> Column:
    """Lower-case words, with repeats."""
    # in full lower case "İ" is an i and a mark, which would split the word
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("İ"), F.lit("i")))
    return F.regexp_extract_all(low, F.lit(_WORDS), F.lit(0))


def raw_tokens(text: Column) -> Column:
    """Lower-case words without stop words and without tokens of one byte, with repeats."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words(text), lambda w: (F.octet_length(w) > 1) & ~F.array_contains(stop, w))


def _expansions() -> Column:
    pairs = []
    for term in sorted({*SYNONYMS, *_CANONICAL}):
        pairs += [F.lit(term), F.array(*[F.lit(x) for x in [term, *expand(term)]])]
    return F.create_map(*pairs)


def expanded_tokens(text: Column) -> Column:
    """Raw tokens, each followed by its synonyms, with repeats."""
    return F.flatten(F.transform(raw_tokens(text), with_synonyms))


def with_synonyms(word: Column) -> Column:
    """The word, followed by its synonyms."""
    return F.coalesce(F.try_element_at(_expansions(), word), F.array(word))


def tokenize(text: Column) -> Column:
    """Distinct tokens with synonyms, in order."""
    return F.array_distinct(expanded_tokens(text))


_PYTHON_WORDS = re.compile(r"\w+")


def query_tokens(query: str, synonyms: bool = True) -> list[str]:
    """Terms of a query; a single "*:" term stands for a prefix search.

    A canonical phrase counts wherever the query contains its letters.
    """
    query = query.strip().replace("İ", "i")
    if len(query) > 1 and query[0] == query[-1] == '"':
        query = query.strip('"')
    if query.endswith("*"):
        base = query[:-1].lower()
        return [f"*:{base}"] if base else []
    lower = query.lower()
    stop = set(STOP_WORDS)
    out: dict[str, None] = {}
    if synonyms:
        for canonical, sources in _CANONICAL.items():
            if canonical in lower:
                out.update(dict.fromkeys([canonical, *sources]))
    for w in _PYTHON_WORDS.findall(lower):
        if len(w.encode()) > 1 and w not in stop and w not in out:
            out[w] = None
            if synonyms:
                out.update(dict.fromkeys(expand(w)))
    return list(out)


def levenshtein(a: Column | str, b: Column | str) -> Column:
    """Distance in UTF-8 bytes: each byte counts as the Latin-1 letter of its number."""
    byte = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(byte(a), byte(b))


def levenshtein_bytes(a: str, b: str) -> int:
    x, y = a.encode(), b.encode()
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


_STEPS = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("sses", "ss"), ("ies", "y"), ("ing", ""), ("edly", ""), ("ed", ""), ("ly", ""), ("ment", ""), ("s", "")]


def stem(word: str) -> str:
    """A light English stemmer; it is not part of the token pipeline."""
    word = word.lower()
    if len(word) < 4 or word.endswith("ss"):
        return word
    for end, new in _STEPS:
        if word.endswith(end) and len(word) - len(end) + len(new) >= 3:
            return word[: len(word) - len(end)] + new
    return word


def trim(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " "), r"[.!?]")
    return F.filter(F.transform(parts, trim), lambda s: s != "")


#: Kinds in order of precedence, and the letters that speak for each.
SENTENCE_KINDS = {
    "preference": ["prefer", "likes ", "dislikes ", "wants "],
    "decision": ["decided", "decision", "deadline", "ship ", "launch ", "will "],
    "milestone": ["shipped", "launched", "released", "milestone", "completed"],
    "problem": ["bug", "issue", "problem", "blocked", "failed", "error"],
}


def classify_sentence(sentence: Column) -> Column:
    low = F.lower(trim(sentence))
    out = None
    for kind, cues in SENTENCE_KINDS.items():
        any_cue = low.contains(cues[0])
        for c in cues[1:]:
            any_cue = any_cue | low.contains(c)
        out = F.when(any_cue, F.lit(kind)) if out is None else out.when(any_cue, F.lit(kind))
    return out.otherwise(F.lit("note"))


def entity_names(text: Column) -> Column:
    """Distinct capitalised words of at least two ASCII letters, digits, _ or -."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9_-]*[A-Za-z0-9_](?![A-Za-z0-9_])"), F.lit(0))
    return F.array_distinct(found)


def entity_runs(text: Column) -> Column:
    """Distinct runs of letters from a capital on, over two bytes long."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{Lu}\p{L}*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: F.octet_length(x) > 2))


def code_spans(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("`([^`]+)`"), F.lit(1)))


def normalize_label(label: Column) -> Column:
    return F.translate(F.lower(trim(label)), " /:", "___")


def document_kind(path: Column) -> Column:
    low = F.lower(path)
    ends = lambda *x: F.expr("false") if not x else low.rlike("(" + "|".join(re.escape(e) for e in x) + ")$")
    return F.when(ends(".md"), "markdown").when(ends(".go", ".py", ".js"), "code").otherwise("text")


def summarize(text: Column, most: int = 140) -> Column:
    """At most so many UTF-8 bytes; a character that would be cut goes."""
    one = trim(F.regexp_replace(text, "\n", " "))
    fits = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda n: F.octet_length(F.substring(one, F.lit(1), n)) <= most)
    return F.when(F.octet_length(one) <= most, one).otherwise(F.substring(one, F.lit(1), F.size(fits)))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def title(text: Column, words: int = 8) -> Column:
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(parts, 1, words), " ")


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def keywords(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def bank_id(name: str) -> str:
    given = name.strip().lower()
    if not given:
        return "default"
    clean = re.sub(r"[^a-z0-9_-]+", "-", given).strip("-_") or "bank"
    return clean if len(clean) <= 48 else f"{clean[:40]}-{hashlib.sha1(given.encode()).hexdigest()[:8]}"


def merge_distinct(*lists: list[str]) -> list[str]:
    """Non-blank strings in order, each once whatever its case."""
    out: dict[str, str] = {}
    for x in (x.strip() for values in lists for x in values):
        if x:
            out.setdefault(x.lower(), x)
    return list(out.values())


def clip(text: str, most: int) -> str:
    """At most so many UTF-8 bytes, with "..." where that cuts; no character is cut in two."""
    text = text.strip()
    raw = text.encode()
    if most <= 0 or len(raw) <= most:
        return text
    if most <= 3:
        return raw[:most].decode(errors="ignore")
    return raw[: most - 3].decode(errors="ignore").strip() + "..."


def compact_snippet(text: str) -> str:
    raw = text.strip().encode()
    return raw[:197].decode(errors="ignore") + "..." if len(raw) > 200 else text.strip()


def compact_title(text: str) -> str:
    return clip(compact_snippet(text), 96) or "Knowledge"


def expand_query(query: str, keywords: list[str] = (), alternates: list[str] = ()) -> list[str]:
    """Query, keywords and alternate queries in order, each non-blank one once."""
    return list(dict.fromkeys(x.strip() for x in (query, *keywords, *alternates) if x.strip()))


def names_in(text: str) -> list[str]:
    """Runs of letters from a capital on, of over two bytes, in order and with repeats."""
    out, run = [], ""
    for c in text + " ":
        if c.isupper() or (c.isalpha() and run):
            run += c
        else:
            if len(run.encode()) > 2:
                out.append(run)
            run = ""
    return out


def keyword_list(text: str) -> list[str]:
    return "".join(c if c.isalpha() or c.isdecimal() else " " for c in text.lower()).split()


def distinct(values) -> list[str]:
    """Trimmed non-blank strings, each once, in order."""
    return list(dict.fromkeys(v.strip() for v in values if v and v.strip()))


def chunk_spans(text: str, size: int = 500, overlap: int = 125) -> list[tuple[int, int]]:
    """(start, end) of overlapping chunks that end at a sentence where one ends in their second half; the
    chunk's last character doesn't count, so an earlier sign cuts a chunk that ends with one anyway."""
    size = size if size > 0 else 500
    overlap = overlap if 0 <= overlap < size else size // 4
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(at + size, n)
        if end < n:
            cut = max(text.rfind(c, at + size // 2 + 1, end - 1) for c in "。！？\n.!?")
            end = cut + 1 if cut >= 0 else end
        out.append((at, end))
        at = end - overlap if end - overlap > at else end
    return out


#: Characters of text whose chunks are in a Python worker's memory at a time, if no single text has more.
CHUNKED = 1 << 20


def chunker(size: int = 500, overlap: int = 125) -> Callable[[Column], Column]:
    """Column of text to an array of (chunk_no, start, end, content), in Arrow batches."""
    kind = pa.list_(pa.struct([("chunk_no", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("content", pa.string())]))

    @arrow_udf("array<struct<chunk_no:int,start:int,end:int,content:string>>")
    def chunks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out, held = [], 0
            for x in texts:
                t = x.as_py() or ""
                out.append([{"chunk_no": i, "start": a, "end": b, "content": t[a:b]} for i, (a, b) in enumerate(chunk_spans(t, size, overlap))])
                held += len(t)
                if held >= CHUNKED:
                    yield pa.array(out, kind)
                    out, held = [], 0
            yield pa.array(out, kind)

    return chunks
