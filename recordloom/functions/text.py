"""Text functions: column in, column out."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words of a status change, words of routine operations, technical terms, and the tags of a client's blocks.
LIFECYCLE_TERMS = ("変更", "置き換", "廃止", "撤回", "却下", "承認", "採用", "修正", "supersed", "revert", "reject", "cancel", "replace", "approve", "accept")
ROUTINE_TERMS = ("squash", "merge", "ready", "draft", "ci成功", "pr #", "pr#")
TECH_TERM = r"[A-Za-z][A-Za-z0-9_.:/\\-]{2,}|\p{Nd}+(?:\.\p{Nd}+)+"
INTERNAL_TAGS = ("environment_context", "recommended_plugins", "permissions instructions", "skills_instructions", "app-context", "collaboration_mode", "apps_instructions", "plugins_instructions")


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strip_blocks(c: Column, tags: tuple[str, ...] = INTERNAL_TAGS) -> Column:
    """Without tagged blocks, their attributes and contents, whatever the case."""
    for tag in tags:
        t = re.escape(tag)
        c = F.regexp_replace(c, rf"(?isU)<{t}(?:\s[^>]*)?>.*?</{t}>", "")
    return c


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which the JVM functions lack."""
    return s.map(lambda x: x if x is None or unicodedata.is_normalized("NFKC", x) else unicodedata.normalize("NFKC", x))


def composed(c: Column) -> Column:
    """c in compatibility composition. ASCII texts are composed as they are: only a null of theirs goes to Python."""
    return F.coalesce(nfkc(F.when(F.octet_length(c) != F.char_length(c), c)), c)


def normalized(c: Column, compose: bool = True) -> Column:
    """Letters and numbers only, composed and lower-cased. Without compose for text known to be composed."""
    return F.regexp_replace(F.lower(composed(c) if compose else c), r"[^\p{L}\p{N}]", "")


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters; a text of one to three is its own, an empty one has none."""
    n = F.char_length(c)
    part = lambda k: F.regexp_extract_all(c, F.lit(r"(?s)(.)(?=(..))"), k)
    runs = F.array_distinct(F.zip_with(part(1), part(2), lambda a, b: F.concat(a, b)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= 3, F.array(c)).otherwise(runs)


def dice(a: Column, b: Column) -> Column:
    """1 if both sets are empty, 0 if one is."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def jaccard(a: Column, b: Column) -> Column:
    """0 if both sets are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def tech_terms(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(TECH_TERM), 0), F.lower))


def contains_any(c: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(F.lower(c), F.lit(t))
    return found


def role_title(c: Column) -> Column:
    """Each run of cased letters with a capital; an empty or null role is Unknown."""
    runs = F.regexp_extract_all(F.when(F.coalesce(c, F.lit("")) == "", "Unknown").otherwise(c), F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), 0)
    return F.array_join(F.transform(runs, F.initcap), "")


def short_hash(c: Column, digits: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def percent(part: Column, whole: Column) -> Column:
    return F.format_string("%.2f%%", F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100)


def reduction(part: Column, whole: Column) -> Column:
    """1 - part / whole, to six places; 0 without a whole."""
    return F.coalesce(F.round(1 - F.try_divide(part.cast("double"), whole.cast("double")), 6), F.lit(0.0))


def section_number(c: Column) -> Column:
    """The number in SEC-ddd, with three digits; a null is null, and anything else raises."""
    bad = F.raise_error(F.concat(F.lit("invalid Section id: "), c)).cast("int")
    return F.when(c.rlike(r"^SEC-[0-9]{3}\z"), F.substring(c, 5, 3).cast("int")).when(c.isNotNull(), bad)


def event_id(session: Column, kind: Column, line: Column) -> Column:
    return F.format_string("%s-%s-%06d", session, F.when(kind == "message", "msg").otherwise("evt"), line)


def matches(pattern: str, c: Column) -> Column:
    """Whether the whole text matches; null does not."""
    return F.coalesce(c.rlike(f"^(?:{pattern})\\z"), F.lit(False))
