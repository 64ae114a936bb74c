"""Secret scan with multipart credential linking.

Each text is scanned once for parts of credentials. Parts that name themselves
(assigned secrets, access ids, long hex strings) are always reported. Weak
candidates (account names, opaque strings, endpoints) are reported only if
complementary parts stand in the same scope, ``SCOPE`` code points around them:
a strong part of another role, or parts of both other roles.

Roles: identifier (access, account), secret (assign, hex, opaque), endpoint.

The scope test is an interval join by position bins of one scope's width. A part
lies in every bin that it covers; per bin, role and strength the first start and the
last end of its parts are kept. A candidate meets these rows, not the parts: any part
in a bin that the candidate covers is near, of the bin before it the last end decides
and of the bin after it the first start. The test is exact, and a text with thousands
of parts makes no pairs of them; rows grow with the length of what the parts cover.

With ``gaps``, as the query asks, the distance is that from the end of a part to the
start of the next, so that a long secret does not push what follows it out of scope;
without it parts are points, their starts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import text_of, written

#: Code points between the starts (with ``gaps``: between the end and the start) of two parts of one credential, at most.
SCOPE = 200

#: Fixed values of the contract: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Candidates of this library.
WEAK = (
    ("account", r"""(?ai)\b(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", 1, 3),
    ("opaque", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}", 0, 20),
    ("endpoint", r"""(?ai)\b(?:https?|wss?|ftps?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+""", 0, 8),
)
KINDS = [k for k, *_ in BASE + WEAK]
ROLE = {"access": "identifier", "account": "identifier", "assign": "secret", "hex": "secret",
        "opaque": "secret", "endpoint": "endpoint"}
STRONG = [k for k, *_ in BASE]

#: A text without any of these has no part at all (checked before the scan; hex runs
#: of 16 and names of keys, in either case).
MAY_HOLD = (r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}|://|(?i:password|passwd|secret|token|api_?key|user|login|account|client_?id)"
            r"|[A-Za-z0-9+/_-]{20}")


def parts_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every part, in order; weak ones not over a base span."""
    found = []
    for k, (_, pattern, group, least) in enumerate(BASE):
        # A run shorter than the least length can't be part of a longer one: ask for long runs only.
        for m in re.finditer(r"[0-9a-f]{16,}" if KINDS[k] == "hex" else pattern, text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end()))
    taken = sorted((s, e) for s, _, e in found)
    base, i = len(BASE), 0
    weak = [(m.start(group), base + k, m.end(group)) for k, (_, pattern, group, least) in enumerate(WEAK)
            for m in re.finditer(pattern, text) if m.end(group) - m.start(group) >= least]
    reach = 0
    for start, kind, end in sorted(weak):
        while i < len(taken) and taken[i][0] < end:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= start:
            found.append((start, kind, end))
    return sorted(found)


def _scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: parts_of(t) if t else [])


def credential_parts(docs: DataFrame, scope: int = SCOPE, gaps: bool = False) -> DataFrame:
    """(seq, doc_id, parts): the reported parts of every row, in order of start, then kind."""
    text = text_of()
    scan = F.pandas_udf(_scan, "array<struct<start:int,kind:int,end:int>>")
    scanned = docs.select(F.monotonically_increasing_id().alias("seq"), "doc_id",
                          scan(F.when(text.rlike(MAY_HOLD), text).otherwise(F.lit(""))).alias("parts"))
    scanned = written(scanned, "parts")
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("kind") + 1)
    first_bin = F.floor(F.col("start") / scope)
    last_bin = F.floor(F.col("end" if gaps else "start") / scope)
    # Only texts with a weak candidate need the join.
    part = (scanned.where(F.exists("parts", lambda p: p["kind"] >= len(STRONG)))
                   .select("seq", F.explode("parts").alias("part")).select("seq", "part.*")
                   .withColumns({"role": role, "strong": F.col("kind") < len(STRONG), "first_bin": first_bin, "last_bin": last_bin}))
    reach = F.col("end" if gaps else "start")
    covered = (part.select("seq", F.explode(F.sequence("first_bin", "last_bin")).alias("bin"),
                           F.col("role").alias("other"), F.col("strong").alias("other_strong"), "start", reach.alias("reach"))
                   .groupBy("seq", "bin", "other", "other_strong")
                   .agg(F.min("start").alias("first"), F.max("reach").alias("last")))
    weak = (part.where(~F.col("strong")).withColumn("reach", reach)
                .withColumn("bin", F.explode(F.sequence(F.col("first_bin") - 1, F.col("last_bin") + 1))))
    near = ((F.col("role") != F.col("other"))
            & F.when(F.col("bin") < F.col("first_bin"), F.col("start") - F.col("last") <= scope)
               .when(F.col("bin") > F.col("last_bin"), F.col("first") - F.col("reach") <= scope)
               .otherwise(F.lit(True)))
    linked = (weak.join(covered, ["seq", "bin"]).where(near)
                  .groupBy("seq", "start", "kind", "end")
                  .agg(F.max("other_strong").alias("by_strong"), F.countDistinct("other").alias("roles"))
                  .where(F.col("by_strong") | (F.col("roles") == 2)))
    reported = linked.groupBy("seq").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    base = F.filter("parts", lambda p: p["kind"] < len(STRONG))
    everything = F.array_sort(F.concat(base, F.coalesce("linked", F.array().cast(scanned.schema["parts"].dataType))))
    return scanned.join(reported, "seq", "left").select("seq", "doc_id", everything.alias("parts"))


def _listed(parts: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(
        ":", F.element_at(names, p["kind"] + 1), p["start"].cast("string"), p["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, scope: int = SCOPE, gaps: bool = False) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all reported spans.

    A span is a whole match in code points, end exclusive (of an account, the
    name alone). Defined results: a null text counts as empty and has no spans;
    repeated rows are reported each; an empty table gives no rows.
    """
    found = credential_parts(docs, scope, gaps)
    base = F.filter("parts", lambda p: p["kind"] < len(STRONG))

    def count(kind):
        return F.size(F.filter("parts", lambda p: p["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(STRONG)]
    n_linked = (F.size("parts") - F.size(base)).cast("long").alias("n_linked")
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
                        _listed(F.col("parts")).alias("spans"), n_linked)
