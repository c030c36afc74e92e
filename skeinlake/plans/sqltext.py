"""DuckDB expressions of the text functions, from the same fixed values."""

from __future__ import annotations

from skeinlake.functions.text import ALIASES


def bigrams(r: str) -> str:
    return f"list_transform(range(1, length({r})), lambda i: substr({r}, i, 2))"


def ranking_tokens(t: str) -> str:
    return f"list_concat(regexp_extract_all(lower({t}), '[a-z0-9][a-z0-9+#._-]*'), flatten(list_transform(regexp_extract_all({t}, '[㐀-鿿]+'), lambda r: CASE WHEN length(r) > 2 THEN list_concat([r], {bigrams('r')}) ELSE [r] END)))"


def lexical_tokens(t: str) -> str:
    return f"list_distinct(list_concat(regexp_extract_all(lower({t}), '[a-z0-9][a-z0-9+#._-]*'), flatten(list_transform(regexp_extract_all({t}, '[㐀-鿿]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE {bigrams('r')} END))))"


def expand_aliases(t: str) -> str:
    return f"concat_ws(' ', lower({t}), " + ", ".join(f"CASE WHEN contains(lower({t}), '{k}') THEN '{v}' END" for k, v in ALIASES.items()) + ")"


def squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def canonical_url(u: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({u}, '#.*$', ''), '\\?.*$', ''), '/+$', '')"


def html_to_text(h: str) -> str:
    bare = f"regexp_replace(regexp_replace(regexp_replace({h}, '<!--.*?-->', ' ', 'gs'), '<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'gis'), '<[^>]+>', ' ', 'gs')"
    for ref, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = f"replace({bare}, '{ref}', '{letter}')"
    return squeeze(bare)


def fingerprint(t: str) -> str:
    return f"regexp_replace(lower(CASE WHEN regexp_matches({t}, '^[ \\t]*#') THEN regexp_replace({t}, '^[^\\n]*\\n?', '') ELSE {t} END), '\\s+', '', 'g')"


def token_estimate(t: str) -> str:
    return f"greatest(1, length(regexp_replace({t}, '[^㐀-鿿]', '', 'g')) + ceil(length(regexp_replace({t}, '[㐀-鿿]', '', 'g')) / 4))::BIGINT"
