"""Column functions on text: tokens, aliases, URLs, hashes, citations, excerpts. Python runs on the rows for fingerprints and records' lengths."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from .markdown import normal_form

#: Chinese terms and the English words that a query or record which holds them also gets.
ALIASES = {
    "数组": "array",
    "链表": "linked list",
    "哈希": "hash table",
    "字符串": "string",
    "双指针": "two pointer",
    "二叉树": "binary tree",
    "回溯": "backtracking",
    "贪心": "greedy",
    "动态规划": "dynamic programming",
    "单调栈": "monotonic stack",
    "图论": "graph",
    "并查集": "union find",
    "最短路": "shortest path",
    "二分查找": "binary search",
    "两数之和": "two sum",
}
LATIN = "[a-z0-9][a-z0-9+#._-]*"
HAN = "[㐀-鿿]+"
_LATIN, _HAN = re.compile(LATIN), re.compile(HAN)


def _bigrams(run: Column) -> Column:
    """Two-letter windows; none of runs shorter than two (a sequence down to zero would count backwards)."""
    return F.when(F.length(run) >= 2, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def ranking_tokens(text: Column) -> Column:
    """Tokens with repeats: Latin words in lower case; each run of Han letters, and of runs longer than two also all bigrams."""
    runs = F.transform(_found(text, HAN), lambda r: F.when(F.length(r) > 2, F.concat(F.array(r), _bigrams(r))).otherwise(F.array(r)))
    return F.concat(_found(F.lower(text), LATIN), F.flatten(runs))


def lexical_tokens(text: Column) -> Column:
    """Distinct tokens: Latin words in lower case; single Han letters, and bigrams of longer runs."""
    runs = F.transform(_found(text, HAN), lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(_bigrams(r)))
    return F.array_distinct(F.concat(_found(F.lower(text), LATIN), F.flatten(runs)))


def expand_aliases(text: Column) -> Column:
    """Lower case, with the English of each Chinese term that the text holds."""
    low = F.lower(text)
    return F.concat_ws(" ", low, *[F.when(low.contains(k), v) for k, v in ALIASES.items()])


#: Where a query names a problem's number.
NUMBER_PATTERNS = (r"(?i)(?:leetcode|力扣|lc|题号)\s*[#第]?\s*([0-9]{1,6})", r"(?i)^\s*#?([0-9]{1,6})(?:\s|[.、：:])")


def expand_query(text: Column) -> Column:
    """Aliases, and eight copies of an identifier token for each number named."""
    numbers = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in NUMBER_PATTERNS])
    ids = F.flatten(F.transform(numbers, lambda n: F.array_repeat(F.concat(F.lit("lc-id-"), n), 8)))
    return F.concat_ws(" ", expand_aliases(text), ids)


def record_tokens(title: Column, metadata: Column, content: Column, document: Column, problem: Column) -> Column:
    """A record's tokens: its title three times, metadata and content; eight identifier tokens of a problem, four of the document."""
    plain, slug = ranking_tokens(_record(title, metadata, content)), _slug(document)
    none = F.array().cast("array<string>")
    boosts = F.when(problem.isNotNull(), F.array_repeat(F.concat(F.lit("lc-id-"), problem.cast("string")), 8)).otherwise(none)
    return F.concat(plain, boosts, F.when(slug != "", F.array_repeat(F.concat(F.lit("doc-id-"), slug), 4)).otherwise(none))


def _record(title: Column, metadata: Column, content: Column) -> Column:
    return F.concat_ws(" ", title, title, title, metadata, content)


def _slug(document: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(document), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")


def record_length(title: Column, metadata: Column, content: Column, document: Column, problem: Column) -> Column:
    """How many tokens a record has, counted without making them in Spark."""
    return _counted(F.lower(_record(title, metadata, content))) + F.when(problem.isNotNull(), 8).otherwise(0) + F.when(_slug(document) != "", 4).otherwise(0)


@F.pandas_udf(IntegerType())
def _counted(texts: pd.Series) -> pd.Series:
    """The number of a text's ranking tokens (in lower case); Spark's regular expressions take several times as long on long texts."""
    return texts.map(lambda t: len(_LATIN.findall(t)) + (0 if t.isascii() else sum(len(r) if len(r) > 2 else 1 for r in _HAN.findall(t))), na_action="ignore")


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lexical_score(query: Column, candidate: Column) -> Column:
    """12 if the candidate holds the whole query; each common token 2 (1 if it has one or two letters); 4 times the query's share in common."""
    q, c = F.lower(query), F.lower(candidate)
    compact = squeeze(q)
    qt, ct = lexical_tokens(q), lexical_tokens(c)
    common = F.array_intersect(qt, ct)
    weights = F.aggregate(common, F.lit(0.0), lambda s, t: s + F.when(F.length(t) > 2, 2.0).otherwise(1.0))
    whole = F.when((compact != "") & c.contains(compact), 12.0).otherwise(0.0)
    return whole + F.when((F.size(qt) > 0) & (F.size(ct) > 0), weights + 4.0 * F.size(common) / F.size(qt)).otherwise(0.0)


def canonical_url(url: Column) -> Column:
    """Without fragment, query and closing slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"\?.*$", ""), "/+$", "")


def url_category(url: Column) -> Column:
    """The first path part."""
    return F.regexp_extract(canonical_url(url), r"^https?://[^/]+/([^/]+)", 1)


def safe_path(url: Column) -> Column:
    """A relative file name from a URL's path: decoded; in each part other than word letters, dots and hyphens become hyphens,
    which with dots are stripped at its ends ("page" if nothing is left) and it is cut at 120; ten digits of the URL's hash end the last."""
    path = F.regexp_replace(F.try_url_decode(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)), "^/+|/+$", "")
    parts = F.transform(F.split(F.coalesce(F.nullif(path, F.lit("")), F.lit("index")), "/"), _path_part)
    leaf = F.regexp_replace(F.element_at(parts, -1), r"\.html$", "")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return F.array_join(F.concat(folders, F.array(F.concat(leaf, F.lit("-"), F.left(F.sha2(url, 256), F.lit(10)), F.lit(".md")))), "/")


def _path_part(p: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(p, "[^0-9A-Za-z._-]+", "-"), "^[.-]+|[.-]+$", "")
    return F.left(F.coalesce(F.nullif(clean, F.lit("")), F.lit("page")), F.lit(120))


def first_heading(text: Column) -> Column:
    """What stands behind the first line's "# "; null if no line has it."""
    return F.nullif(F.regexp_extract(text, r"(?m)^[ \t]*# (.*)$", 1), F.lit(""))


def problem_section(page: Column, slug: Column) -> Column:
    """A problem's statement in a rendered page: from the link that names it up to the comments; null if that is shorter than 200 letters."""
    shown = strip(F.split_part(page, F.lit("评论 ("), F.lit(1)))
    link = F.concat(F.lit(r"\[[^\]]+\]\(https://leetcode\.cn/problems/"), F.regexp_replace(slug, r"([^0-9A-Za-z])", r"\\$1"), F.lit(r"/?\)"))
    at = F.regexp_instr(shown, link)
    own = F.when(at > 0, F.substr(shown, at)).otherwise(shown)
    return F.when(F.length(own) >= 200, own)


def compact_title(title: Column) -> Column:
    """What stands before the first " | ", trimmed, at most 500 letters."""
    return F.left(F.trim(F.substring_index(title, " | ", 1)), F.lit(500))


def excerpt(text: Column, limit: int = 3500, tail: str = "\n[片段已截断]") -> Column:
    clean = strip(F.replace(text, F.lit("\0"), F.lit("")))
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.regexp_replace(F.left(clean, F.lit(limit)), r"\s+$", ""), F.lit(tail)))


def short_excerpt(text: Column, limit: int = 600) -> Column:
    """White space squeezed, at most limit letters, the last an ellipsis if cut."""
    flat = squeeze(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.left(flat, F.lit(limit - 1)), r"\s+$", ""), F.lit("…")))


def first_truthy(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def metric_value(text: Column) -> Column:
    """1.2K, 3M, 5万 and 1,234 as a whole number, cut down; null for anything else."""
    plain = F.regexp_replace(strip(text), ",", "")
    value = F.regexp_extract(plain, r"^([0-9]+(?:\.[0-9]+)?)[KkMm万]?$", 1)
    unit = F.regexp_extract(plain, r"([KkMm万])$", 1)
    factor = F.when(F.upper(unit) == "K", 1e3).when(F.upper(unit) == "M", 1e6).when(unit == "万", 1e4).otherwise(1.0)
    return F.when(value != "", F.floor(F.nullif(value, F.lit("")).cast("double") * factor + 1e-6).cast("long"))


def stable_hash(*parts: Column) -> Column:
    """sha256 of the parts, joined by the unit separator's symbol."""
    return F.sha2(F.concat_ws("␟", *parts), 256)


def citations(text: Column) -> Column:
    """Evidence ids in square brackets: R1, W2."""
    return F.regexp_extract_all(text, F.lit(r"\[((?:R|W)[0-9]+)\]"), F.lit(1))


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"https?://[^\s)>]+"), F.lit(0))


def token_estimate(text: Column) -> Column:
    """Han letters count one each, four others one; at least 1."""
    han = F.regexp_count(text, F.lit("[㐀-鿿]"))
    return F.greatest(F.lit(1), han + F.ceil((F.length(text) - han) / 4)).cast("long")


def html_to_text(text: Column) -> Column:
    """Tags and comments gone, common references decoded, white space squeezed."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", " "), r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " "), r"(?s)<[^>]+>", " ")
    for ref, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(ref), F.lit(letter))
    return squeeze(bare)


#: Ranges of letters that compatibility composition leaves as they are, alone or behind one another: Latin, Cyrillic, kana, Han, Hangul, dashes and quotes.
STABLE = (
    r"\x00-\x7F\u00C0-\u012F\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0180-\u01C3\u01CD-\u01F0\u01F4-\u024F"
    r"\u0400-\u0482\u048A-\u052F\u2010\u2012-\u2015\u2018-\u201F\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3"
)


def fingerprint(text: Column) -> Column:
    """For duplicates, as markdown.normal_form has it: without a heading in the first line, compatibility-composed, lower case, without
    white space. Only texts with letters that composition may change go through Python: Spark has none."""
    white = r"[ \t\n\x0B\f\r\x1c-\x1f]"
    body = F.when(text.rlike(rf"^(?:(?!\n){white})*#"), F.regexp_replace(text, r"^[^\n]*\n?", "")).otherwise(text)
    return F.coalesce(normal_forms(F.when(text.rlike(f"[^{STABLE}]"), text)), F.regexp_replace(F.lower(body), f"{white}+", ""))


@F.pandas_udf(StringType())
def normal_forms(texts: pd.Series) -> pd.Series:
    """The fingerprint, in one pass over a text: cheaper than patterns wherever a text goes to Python all the same."""
    return texts.map(normal_form, na_action="ignore")


@F.pandas_udf(StringType())
def fingerprint_sha256(texts: pd.Series) -> pd.Series:
    """sha256 of the fingerprint, in one pass over a text: the digits alone come back from Python."""
    return texts.map(lambda t: hashlib.sha256(normal_form(t).encode()).hexdigest(), na_action="ignore")


def suffix(array: Column, n: int) -> Column:
    """The last n elements; all if there are fewer."""
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), n)
