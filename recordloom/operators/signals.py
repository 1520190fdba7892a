"""Text signals: hints with offsets, no labels. Rules are data."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import SignalFailure
from ..functions.shape import non_blank
from ..schemas import SIGNAL_TYPES
from ..session import stored

# Signal type, rule id and pattern of the phrase rules.
PHRASE_RULES = (
    ("request_candidate", "phrase-request-v1", r"(?:して\s*(?:ください|下さい|ほしい|欲しい)|(?:実装|追加|作成|変更|修正|確認|対応)して|お願い(?:します|したい|できる)|依頼(?:します|したい))"),
    ("acceptance_candidate", "phrase-acceptance-v1", r"(?:(?:それ|これ|その案|この案)?で\s*(?:進め|いこう|行こう)|で\s*(?:お願い(?:します)?|いい|良い)|採用(?:する|します)?|承認(?:する|します)?|その方針で)"),
    ("rejection_candidate", "phrase-rejection-v1", r"(?:やめ(?:る|よう)|止め(?:る|よう)|中止(?:する)?|停止(?:する)?|見送(?:る|ります)|却下(?:する)?|廃止(?:する)?|採用しない|使わない|不要(?:です|とする)?)"),
    ("uncertainty_candidate", "phrase-uncertainty-v1", r"(?:まだ\s*決め|保留|未定|検討中|かもしれない|かも(?:しれ)?|必要になったら|再検討|判断できない|分からない|わからない)"),
    ("alternative_candidate", "phrase-alternative-v1", r"(?:ではなく|じゃなく(?:て)?|代わりに|または|もしくは|どちら(?:に|が|を|で|\?|？)|比較(?:する|して|した))"),
    ("reason_candidate", "phrase-reason-v1", r"(?:ので|ため(?:に|、|,|\s)|から(?:、|,|\s)|理由(?:は|で|として))"),
)
SIGNAL = "struct<type:string,sources:array<string>,rule_ids:array<string>,trigger:string,char_start:int,char_end:int,reason:string>"
# Lemmas of each signal type, lemmas of decisions, relations of reason clauses, and words that a reason holds.
LEMMAS = {
    "request_candidate": ("頼む", "願う", "依頼"), "acceptance_candidate": ("採用", "承認", "決定", "進める"), "rejection_candidate": ("止める", "やめる", "中止", "停止", "見送る", "却下", "廃止"),
    "uncertainty_candidate": ("保留", "未定", "再検討", "迷う"), "alternative_candidate": ("代わり", "比較", "選択"), "reason_candidate": ("理由",),
}
DECISION_LEMMAS = ("する", "変える", "変更", "採用", "決定", "進める", "止める", "やめる", "中止", "廃止")
REASON_RELATIONS = ("advcl", "ccomp")
REASON_WORDS = r"(?:ので|から|ため|理由|せい|ゆえ)"
#: Tokens of a text, as an analyser gives them: head is the place of the token that one depends on, its own for a root.
TOKENS = "session_id string, evidence_id string, i int, token string, lemma string, dep string, head int, char_start int, char_end int"
#: Tokens that a task folds at once.
TOKENS_AT_ONCE = 20_000
#: Optional annotators by name (say, of lemmas): texts (key, content) to hits (key and the fields of SIGNAL).
ANNOTATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def hits(c: Column, pattern: str) -> Column:
    """All matches in order, with code-point offsets: array of (trigger, char_start, char_end). Most texts have none, which one search tells."""
    none = F.array().cast("array<struct<trigger:string,char_start:int,char_end:int>>")
    p = F.lit(f"(?U){pattern}")
    found, gaps = F.regexp_extract_all(c, p, 0), F.split(c, f"(?U){pattern}", -1)
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, x):
        lo = acc["at"] + F.char_length(x["gap"])
        hi = lo + F.char_length(x["hit"])
        one = F.struct(x["hit"].alias("trigger"), lo.cast("int").alias("char_start"), hi.cast("int").alias("char_end"))
        return F.struct(hi.cast("int").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("h")), lambda x: F.struct(x["g"].alias("gap"), x["h"].alias("hit")))
    return F.when(c.rlike(f"(?U){pattern}"), F.aggregate(pairs, start, step)["out"]).when(c.isNotNull(), none)


def phrase_signals(c: Column, rules=PHRASE_RULES) -> Column:
    """Hits of all rules, as signals."""
    def of(kind, rule, pattern):
        return F.transform(hits(c, pattern), lambda h: F.struct(
            F.lit(kind).alias("type"), F.array(F.lit("phrase")).alias("sources"), F.array(F.lit(rule)).alias("rule_ids"), h["trigger"].alias("trigger"),
            h["char_start"].alias("char_start"), h["char_end"].alias("char_end"), F.lit(None).cast("string").alias("reason")))

    return F.concat(*(of(*r) for r in rules))


def analysed(texts: DataFrame, load: Callable[[], Callable], batch: int = 16) -> DataFrame:
    """Tokens of texts (session_id, evidence_id, content). load() makes an analyser, once per worker; it takes batch texts at a
    time and gives for each a list of (token, lemma, dep, head, char_start)."""
    def run(frames):
        analyser = _analysers.get(load) or _analysers.setdefault(load, load())
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch]
                rows = [(s, e, i, t, lemma, dep, head, at, at + len(t)) for s, e, tokens in zip(part["session_id"], part["evidence_id"], analyser(part["content"].tolist())) for i, (t, lemma, dep, head, at) in enumerate(tokens)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in TOKENS.split(", ")])

    return texts.select("session_id", "evidence_id", "content").mapInPandas(run, TOKENS)


_analysers: dict = {}


def _signal(kind, source: str, rule, trigger, start, end, reason=None) -> list[Column]:
    none = F.lit(None).cast("string")
    return [kind.alias("type"), F.array(F.lit(source)).alias("sources"), F.array(rule).alias("rule_ids"), trigger.alias("trigger"), start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), (none if reason is None else reason).alias("reason")]


def lemma_signals(tokens: DataFrame, lemmas: Mapping[str, tuple[str, ...]] = LEMMAS) -> DataFrame:
    """A hit of each signal type that lists a token's lemma: session_id, evidence_id and the fields of SIGNAL."""
    kinds = F.array_compact(F.array(*(F.when(F.col("lemma").isin(*some), F.lit(kind)) for kind, some in lemmas.items())))
    d = tokens.withColumn("_kind", F.explode(kinds))
    return d.select("session_id", "evidence_id", *_signal(F.col("_kind"), "spacy_matcher", F.concat("_kind", F.lit("__lemma-v1")), F.col("token"), F.col("char_start"), F.col("char_end")))


def spans_below(tokens: list[tuple[int, int, int, int]]) -> dict[int, tuple[int, int]]:
    """For each token (place, head, start, end) of a text, the first start and last end of what hangs below it, itself included.

    Bottom-up, each token handed to its head once all below it are in; what is left then are rings of heads, whose tokens all hang
    below each other. A head that isn't there, or is the token itself, ends a chain.
    """
    at = {t[0]: k for k, t in enumerate(tokens)}
    up = [at.get(head, -1) if head != i else -1 for i, head, _, _ in tokens]
    low, high, waiting = [t[2] for t in tokens], [t[3] for t in tokens], [0] * len(tokens)
    for p in up:
        if p >= 0:
            waiting[p] += 1
    ready = [k for k, n in enumerate(waiting) if not n]
    while ready:
        k = ready.pop()
        p = up[k]
        if p >= 0:
            low[p], high[p] = min(low[p], low[k]), max(high[p], high[k])
            waiting[p] -= 1
            if not waiting[p]:
                ready.append(p)
    for k in range(len(tokens)):
        if waiting[k]:
            ring = [k]
            while up[ring[-1]] != k:
                ring.append(up[ring[-1]])
            a, b = min(low[x] for x in ring), max(high[x] for x in ring)
            for x in ring:
                low[x], high[x], waiting[x] = a, b, 0
    return {t[0]: (low[k], high[k]) for k, t in enumerate(tokens)}


def dependency_signals(tokens: DataFrame, texts: DataFrame, lemmas: tuple[str, ...] = DECISION_LEMMAS, relations: tuple[str, ...] = REASON_RELATIONS, words: str = REASON_WORDS) -> DataFrame:
    """A reason for each decision token with a clause of relations below it, if the clause's text, from the first to the last of
    what hangs below it, holds one of words. The hit spans the clause; its trigger is the decision token.

    Tokens and text of a message meet in one shuffle; a task holds so many tokens at once, or one message's, and folds them bottom-up.
    """
    key = ["session_id", "evidence_id"]
    fields = ("i", "token", "lemma", "dep", "head", "char_start", "char_end")
    token = F.struct(*fields)
    both = tokens.select(*key, token.alias("t"), F.lit(None).cast("string").alias("content")).unionByName(
        texts.select(*key, F.lit(None).cast(tokens.select(token.alias("t")).schema["t"].dataType).alias("t"), "content"))
    whole = both.groupBy(*key).agg(F.collect_list("t").alias("tokens"), F.max("content").alias("content"))
    kinds = [tokens.schema[k].dataType.simpleString() for k in key]

    def run(batches):
        for b in batches:
            at, i = np.cumsum(pc.fill_null(b.column(2).value_lengths(), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(at, (at[i - 1] if i else 0) + TOKENS_AT_ONCE, "right")))
                yield reasons(b.slice(i, j - i))
                i = j

    def reasons(b):
        rows, ends = [], np.cumsum(pc.fill_null(b.column(2).value_lengths(), 0).to_numpy(zero_copy_only=False)).tolist()
        place, token, lemma, dep, head, start, end = (c.to_pylist() for c in b.column(2).flatten().flatten())
        for session, evidence, content, low, high in zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), [0, *ends], ends):
            by = {place[k]: k for k in range(low, high)}
            spans = None
            for k in range(low, high):
                h = by.get(head[k])
                if dep[k] in relations and head[k] != place[k] and h is not None and lemma[h] in lemmas:
                    spans = spans or spans_below([(place[x], head[x], start[x], end[x]) for x in by.values()])
                    first, last = spans[place[k]]
                    rows.append((session, evidence, token[h], first, last, (content or "")[first:last]))
        types = (b.schema.field(0).type, b.schema.field(1).type, pa.string(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, types)], names=[*key, "trigger", "a", "b", "reason"])

    d = whole.mapInArrow(run, f"session_id {kinds[0]}, evidence_id {kinds[1]}, trigger string, a int, b int, reason string").where(F.col("reason").rlike(words))
    return d.select(*key, *_signal(F.lit("reason_candidate"), "spacy_dependency_matcher", F.lit("reason_candidate__dependency-v1"), F.col("trigger"), F.col("a"), F.col("b"), F.col("reason")))


def _spacy(model: str):
    import spacy

    nlp = spacy.load(model)
    return lambda texts: [[(t.text, t.lemma_, t.dep_, t.head.i, t.idx) for t in doc] for doc in nlp.pipe(texts)]


def analyser_of(spec: str) -> Callable[[], Callable]:
    """What makes the analyser that spec names, package.module:function or spacy:MODEL, tried once here: one that isn't there is an error, so that
    no run silently does without it."""
    module, _, name = spec.partition(":")
    try:
        load = partial(_spacy, name) if module == "spacy" else getattr(importlib.import_module(module), name)
        load()([])
    except (ImportError, AttributeError, OSError, ValueError) as e:
        raise SignalFailure(f"analyser is not available: {spec or 'none named'} ({e})") from e
    return load


#: What the annotators that need an analyser make of its tokens.
TOKEN_ANNOTATORS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"lemma": lambda tokens, texts: lemma_signals(tokens), "dependency": dependency_signals}


def deduplicate(signals: Column) -> Column:
    """In order of (start, end, type, rules), each signal joins the first kept one of its type that it overlaps.

    The kept one takes over sources and rules, and a reason if it has none; its span stays as it was.
    """
    ordered = F.transform(F.array_sort(F.transform(signals, lambda s: F.struct(s["char_start"].alias("a"), s["char_end"].alias("b"), s["type"].alias("c"), s["rule_ids"].alias("d"), s.alias("s")))), lambda x: x["s"])

    def step(kept, x):
        at = F.array_position(F.transform(kept, lambda k: (k["type"] == x["type"]) & (k["char_start"] < x["char_end"]) & (x["char_start"] < k["char_end"])), True)
        joined = F.transform(kept, lambda k, i: F.when(i + 1 == at, F.struct(
            k["type"].alias("type"), F.array_sort(F.array_union(k["sources"], x["sources"])).alias("sources"), F.array_sort(F.array_union(k["rule_ids"], x["rule_ids"])).alias("rule_ids"),
            k["trigger"].alias("trigger"), k["char_start"].alias("char_start"), k["char_end"].alias("char_end"), F.coalesce(k["reason"], x["reason"]).alias("reason"))).otherwise(k))
        return F.when(at == 0, F.concat(kept, F.array(x))).otherwise(joined)

    return F.aggregate(ordered, F.array().cast(f"array<{SIGNAL}>"), step)


def annotate(messages: DataFrame, rules=PHRASE_RULES, annotators: tuple[str, ...] = (), analyser: str = "") -> DataFrame:
    """Adds signals (null where there are none) and previous (evidence_id, actor, types of the message before; null for the
    first, and where there are no signals).

    Only human and assistant messages with text are examined. annotators names further ones: lemma and dependency, which take the tokens of
    the analyser (analyser_of), made once and stored, or those in ANNOTATORS. One that isn't there is an error.
    """
    lost = sorted(set(annotators) - set(ANNOTATORS) - set(TOKEN_ANNOTATORS))
    if lost:
        raise SignalFailure(f"no such annotator: {', '.join(lost)}")
    eligible = F.col("actor").isin("human", "assistant") & non_blank(F.col("content"))
    d = messages.withColumn("examined", F.coalesce(eligible, F.lit(False)))
    found = F.when(F.col("examined"), phrase_signals(F.col("content"), rules)).otherwise(F.array().cast(f"array<{SIGNAL}>"))
    d = d.withColumn("_s", found.cast(f"array<{SIGNAL}>"))
    texts = d.where("examined").select("session_id", "evidence_id", "content")
    tokens = stored(analysed(texts, analyser_of(analyser)), "tokens") if set(annotators) - set(ANNOTATORS) else None
    for name in annotators:
        more = ANNOTATORS[name](texts) if name in ANNOTATORS else TOKEN_ANNOTATORS[name](tokens, texts)
        more = more.groupBy("session_id", "evidence_id").agg(F.collect_list(F.struct("type", "sources", "rule_ids", "trigger", "char_start", "char_end", "reason")).alias("_more"))
        d = d.join(more, ["session_id", "evidence_id"], "left").withColumn("_s", F.concat("_s", F.coalesce("_more", F.array().cast(f"array<{SIGNAL}>")))).drop("_more")
    d = d.withColumn("signals", deduplicate(F.col("_s"))).withColumn("signals", F.when(F.size("signals") > 0, F.col("signals"))).drop("_s")
    types = F.array_sort(F.array_distinct(F.transform(F.coalesce("signals", F.array().cast(f"array<{SIGNAL}>")), lambda s: s["type"])))
    before = F.lag(F.struct("evidence_id", "actor", types.alias("signal_types"))).over(W.partitionBy("session_id").orderBy("source_line", "evidence_id"))
    return d.withColumn("previous", before).withColumn("previous", F.when(F.col("signals").isNotNull(), F.col("previous")))


def counts(annotated: DataFrame, by: list[str]) -> DataFrame:
    """Per group: messages examined, messages with signals, and a count of each of the six types, zero where it has none."""
    of = lambda t: F.coalesce(F.sum(F.size(F.filter("signals", lambda s: s["type"] == t))), F.lit(0)).alias(t)
    return annotated.groupBy(*by).agg(F.count_if("examined").alias("messages_examined"), F.count_if(F.col("signals").isNotNull()).alias("messages_with_signals"), *map(of, SIGNAL_TYPES))


def roll_up(per_section: DataFrame, by: list[str]) -> DataFrame:
    names = ["messages_examined", "messages_with_signals", *SIGNAL_TYPES]
    return per_section.groupBy(*by).agg(*(F.sum(n).alias(n) for n in names))


def annotation_report(annotated: DataFrame, annotators: tuple[str, ...] = ()) -> DataFrame:
    """Per session: counts, and which annotators ran."""
    return counts(annotated, ["session_id"]).withColumn("annotators", F.array(F.lit("phrase"), *map(F.lit, annotators)))


def growth(before: Column, after: Column) -> Column:
    return F.try_divide(after.cast("double"), before.cast("double")) - 1
