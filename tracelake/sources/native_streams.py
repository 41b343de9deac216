"""Public streams of native agents as trace records, receipts with their scopes, and capture gaps.

Packets are parsed once into a stored table. The turn of a packet is a running count of start packets and a turn ends at its first valid
end packet; what follows before the next start is ignored and leaves a gap. Calls meet results by (run, turn, call id), never by adjacency:
a full join whose one-sided rows are the missing and the orphan results. A gap code is kept once for each run. The scope of a receipt is rows
(run_id, receipt_id, event_id, at), so a turn of any length is no list.

Input: (run_id, adapter, agent_version, line_no, raw), ``adapter`` being ``codex`` or ``claude-code``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import answer_hash, native_id, normalize_answer
from ..functions.text import redact_secrets
from ..operators.ordered import last_seen, ordered_scan, running_sum
from ..runtime import stage

# Verified versions, tools with their inputs, and packet types.
VERSIONS = {"codex": "0.160.1", "claude-code": "2.1.121"}
CLAUDE_TOOLS = {"WebSearch": ("SEARCH", "query"), "WebFetch": ("READ", "url"), "Read": ("READ", "file_path")}
_ITEMS = ("item.started", "item.updated", "item.completed")
_SILENT = ("thinking", "redacted_thinking", "text")
SUMMARY_CHARS = 16_000
_LINKS = r"(?m)^Links:\s*(\[[^\n]*\])"

_PACKET = (
    "type string, subtype string, session_id string, thread_id string, claude_code_version string, parent_tool_use_id string, uuid string, result string, is_error boolean, "
    "message struct<content:string>, item struct<id:string,type:string,text:string,query:string,action:struct<type:string,query:string,url:string>,results:string>"
)
_BLOCKS = "array<struct<type:string,id:string,name:string,tool_use_id:string,is_error:boolean,content:string,input:struct<query:string,url:string,file_path:string>>>"
_HITS = "array<struct<url:string,title:string,snippet:string>>"
KEY = ["run_id", "turn", "id"]


@dataclass(frozen=True)
class Capture:
    """``records`` (runs, events, answers), ``scope`` of the answers that declare one, ``gaps`` (run_id, code) and the last state of each run."""

    records: DataFrame
    scope: DataFrame
    gaps: DataFrame
    runs: DataFrame


def _text(c: Column) -> Column:
    return redact_secrets(F.nullif(c, F.lit("")))


def _links(hits: Column) -> Column:
    kept = F.filter(hits, lambda h: F.coalesce(h["url"].rlike(r"(?i)^https?://"), F.lit(False)))
    return F.transform(kept, lambda h, i: F.struct(
        F.concat(F.lit("source-"), native_id(_text(h["url"]))).alias("source_id"), _text(h["url"]).alias("url"), _text(h["title"]).alias("title"), (i + 1).alias("rank")))


def _turns(packets: DataFrame) -> DataFrame:
    """Packets with their turn and session, whether they start or end a turn, and the line at which their turn ends."""
    codex = F.col("adapter") == "codex"
    begins = F.coalesce(F.when(codex, F.col("type") == "turn.started").otherwise((F.col("type") == "system") & (F.col("subtype") == "init")), F.lit(False))
    named = F.when(codex, F.when(F.col("type") == "thread.started", F.col("thread_id"))).otherwise(F.when(begins, F.col("session_id")))
    named = F.nullif(named, F.lit(""))
    rows = packets.withColumns({"begins": begins, "named": named})
    chunk = F.floor(F.col("line_no") / 65_536)
    rows = ordered_scan(
        rows, ["run_id"], ["line_no"], chunk, turn=running_sum(F.col("begins").cast("int")),
        session=last_seen(F.col("named"), F.col("named").isNotNull(), inclusive=True), before=last_seen(F.col("named"), F.col("named").isNotNull()),
    )
    nested = ~codex & F.col("parent_tool_use_id").isNotNull()
    strange = ~codex & F.coalesce((F.col("session_id") != "") & (F.col("session_id") != F.col("session")), F.lit(False)) & ~F.col("begins")
    own = ~nested & ~strange & (F.col("type") != "system")
    rows = stage(rows.withColumns({
        "nested": F.coalesce(nested & (F.col("type") != "system"), F.lit(False)), "strange": strange & ~nested & F.coalesce(F.col("type") != "system", F.lit(False)),
        "ends": F.coalesce(F.when(codex, F.col("type") == "turn.completed").otherwise(own & (F.col("type") == "result")), F.lit(False)),
        "breaks": F.coalesce(codex & F.col("type").isin("turn.failed", "error"), F.lit(False)),
    }))
    line = F.col("line_no")
    turns = rows.groupBy("run_id", "turn").agg(F.min(F.when(F.col("ends"), line)).alias("end"), F.min(F.when(F.col("breaks"), line)).alias("broken"))
    # a failure is final for the run; it counts unless its turn had ended before
    first = turns.where("broken IS NOT NULL AND (end IS NULL OR broken < end)").groupBy("run_id").agg(F.min("broken").alias("failed_at"))
    turns = turns.join(first, "run_id", "left").select("run_id", "turn", F.when(F.col("failed_at").isNull() | (F.col("end") < F.col("failed_at")), F.col("end")).alias("end"), "failed_at")
    return stage(rows.join(turns, ["run_id", "turn"]))


def _claude_blocks(live: DataFrame) -> DataFrame:
    spoken = live.where((F.col("adapter") == "claude-code") & ~F.col("nested") & ~F.col("strange") & F.col("type").isin("assistant", "user") & F.startswith("content", F.lit("[")))
    blocks = spoken.select("run_id", "turn", "line_no", F.col("type").alias("speaker"), F.posexplode(F.from_json("content", _BLOCKS)).alias("pos", "b"))
    blocks = blocks.where(~F.coalesce(F.col("b.type").isin(*_SILENT), F.lit(False)))
    asks = (F.col("speaker") == "assistant") & F.coalesce(F.col("b.type") == "tool_use", F.lit(False))
    answers = (F.col("speaker") == "user") & F.coalesce(F.col("b.type") == "tool_result", F.lit(False))
    side = F.when(asks, "call").when(answers, "result")
    kind, given = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (what, field) in CLAUDE_TOOLS.items():
        is_tool = (F.col("b.name") == name) & (F.coalesce(F.col(f"b.input.{field}"), F.lit("")) != "")
        kind, given = F.when(is_tool, what).otherwise(kind), F.when(is_tool, F.col(f"b.input.{field}")).otherwise(given)
    parts = F.array_join(F.transform(F.filter(F.from_json("b.content", "array<struct<type:string,text:string>>"), lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: redact_secrets(p["text"])), "\n")
    content = F.nullif(F.substring(F.when(F.startswith("b.content", F.lit("[")), parts).otherwise(_text(F.col("b.content"))), 1, SUMMARY_CHARS), F.lit(""))
    blocks = blocks.select(
        "run_id", "turn", "line_no", "pos", side.alias("side"), _text(F.when(asks, F.col("b.id")).otherwise(F.col("b.tool_use_id"))).alias("id"), F.when(asks, kind).alias("kind"),
        F.when(asks, _text(given)).alias("given"), F.when(answers, content).alias("content"), F.when(answers, F.coalesce("b.is_error", F.lit(False))).alias("failed"),
    )
    links = _links(F.from_json(F.nullif(F.regexp_extract("content", _LINKS, 1), F.lit("")), _HITS))
    return blocks.withColumn("links", F.when(F.col("side") == "result", F.coalesce(links, F.array().cast("array<struct<source_id:string,url:string,title:string,rank:int>>"))))


def _codex_items(live: DataFrame) -> DataFrame:
    """Completed searches and pages as calls; those with results as results too."""
    items = live.where((F.col("adapter") == "codex") & (F.col("type") == "item.completed") & (F.col("item.type") == "web_search") & (F.coalesce("item.id", F.lit("")) != ""))
    query = F.coalesce("item.action.query", "item.query")
    search = (F.col("item.action.type") == "search") & (F.coalesce(query, F.lit("")) != "")
    page = (F.col("item.action.type") == "open_page") & (F.coalesce("item.action.url", F.lit("")) != "")
    hits = F.when(F.startswith("item.results", F.lit("[")), F.from_json("item.results", _HITS))
    snippets = F.filter(F.transform(hits, lambda h: _text(h["snippet"])), lambda t: t.isNotNull())
    return items.select(
        "run_id", "turn", "line_no", F.lit(0).alias("pos"), _text(F.col("item.id")).alias("id"), F.when(search, "SEARCH").when(page, "READ").alias("kind"),
        _text(F.when(search, query).when(page, F.col("item.action.url"))).alias("given"), hits.isNotNull().alias("has_results"),
        F.substring(F.array_join(snippets, "\n"), 1, SUMMARY_CHARS).alias("content"), F.coalesce(F.exists(hits, lambda h: h["title"] == "Internal Error"), F.lit(False)).alias("failed"), _links(hits).alias("links"),
    )


def _firsts(rows: DataFrame, values: list[str]) -> DataFrame:
    """The first row of each call id of a turn, and whether another row of it says something else."""
    at, value = F.struct("line_no", "pos"), F.struct(*values)
    return rows.groupBy(*KEY).agg(F.min_by(F.struct("line_no", "pos", *values), at).alias("f"), (F.count_distinct(F.to_json(value)) > 1).alias("clash"))


def native_capture(lines: DataFrame) -> Capture:
    packet = F.from_json("raw", _PACKET)
    packets = stage(
        lines.select("run_id", "adapter", "agent_version", "line_no", packet.alias("p")).select("run_id", "adapter", "agent_version", "line_no", "p.*").withColumn("content", F.col("message.content")).drop("message")
    )
    gaps: list[DataFrame] = []

    def gap(rows: DataFrame, code: str) -> None:
        gaps.append(rows.select("run_id", F.lit(code).alias("code")))

    codex = F.col("adapter") == "codex"
    known = F.coalesce(F.col("type").isNotNull(), F.lit(False))
    gap(packets.where(~known), "NATIVE_MALFORMED")
    gap(packets.where(codex & ~F.col("agent_version").eqNullSafe(F.lit(VERSIONS["codex"]))), "NATIVE_DRIFT")
    rows = _turns(packets.where(known))
    late = F.col("end").isNotNull() & (F.col("line_no") > F.col("end")) & ~F.col("begins")
    live = rows.where(~late)
    gap(rows.where(late & ~F.coalesce(F.col("type") == "thread.started", F.lit(False))), "NATIVE_BOUNDARY")
    gap(live.where("named <> before"), "NATIVE_BOUNDARY")

    # Packets that say something outside the contract
    claude = live.where(~codex)
    gap(claude.where("nested"), "NATIVE_NESTED")
    gap(claude.where("strange"), "NATIVE_BOUNDARY")
    plain = claude.where(~F.col("nested") & ~F.col("strange") & (F.col("type") != "system"))
    drift = (claude.where((F.col("type") == "system") & (~F.col("begins") | ~F.col("claude_code_version").eqNullSafe(F.lit(VERSIONS["claude-code"]))))).select("run_id").union(
        plain.where(~F.col("type").isin("assistant", "user", "result") | (F.col("type").isin("assistant", "user") & ~F.coalesce(F.startswith("content", F.lit("[")), F.lit(False)))).select("run_id"))
    other = live.where(codex & ~F.col("type").isin("thread.started", "turn.started", "turn.failed", "error", "turn.completed"))
    item = other.where(F.col("type").isin(*_ITEMS) & ~F.coalesce(F.col("item.type") == "reasoning", F.lit(False)))
    drift = drift.union(other.where(~F.col("type").isin(*_ITEMS)).select("run_id")).union(item.where(F.coalesce("item.id", F.lit("")) == "").select("run_id"))
    item = item.where(F.coalesce("item.id", F.lit("")) != "")
    gap(item.where(~F.coalesce(F.col("item.type").isin("agent_message", "web_search"), F.lit(False))), "NATIVE_UNKNOWN_TOOL")
    gap(live.where("breaks"), "NATIVE_FAILED")
    # an end after a failure, or a second one, ends nothing
    gap(live.where(codex & F.col("ends") & ~F.col("line_no").eqNullSafe(F.col("end"))), "NATIVE_BOUNDARY")

    # Calls and results
    blocks = stage(_claude_blocks(live))
    drift = drift.union(blocks.where("side IS NULL OR id IS NULL").select("run_id"))
    gap(blocks.where("side = 'call' AND id IS NOT NULL AND kind IS NULL"), "NATIVE_UNKNOWN_TOOL")
    items = stage(_codex_items(live))
    gap(items.where("kind IS NULL"), "NATIVE_UNKNOWN_TOOL")
    gap(drift, "NATIVE_DRIFT")
    said = ["kind", "given"]
    calls = _firsts(blocks.where("side = 'call' AND id IS NOT NULL AND kind IS NOT NULL").select(*KEY, "line_no", "pos", *said).union(items.where("kind IS NOT NULL").select(*KEY, "line_no", "pos", *said)), said)
    calls = stage(calls)
    valid = items.join(calls.select(*KEY, "f"), KEY).where(F.struct("kind", "given") == F.struct("f.kind", "f.given"))
    heard = ["content", "failed", "links"]
    results = stage(_firsts(blocks.where("side = 'result' AND id IS NOT NULL").select(*KEY, "line_no", "pos", *heard).union(valid.where("has_results").select(*KEY, "line_no", "pos", *heard)), heard))
    gap(calls.where("clash").select("run_id").union(results.where("clash").select("run_id")), "NATIVE_BOUNDARY")
    gap(valid.where("NOT has_results"), "NATIVE_MISSING_RESULT")
    # searches that began in the last turn and never came to an end
    last_turn = rows.groupBy("run_id").agg(F.max("turn").alias("last_turn"))
    search = item.where("item.type = 'web_search'").withColumn("id", _text(F.col("item.id")))
    open_at = search.where("type <> 'item.completed'").groupBy(*KEY).agg(F.max("line_no").alias("open_at"))
    shut = valid.select(*KEY, "line_no").union(items.where("kind IS NULL").select(*KEY, "line_no")).groupBy(*KEY).agg(F.max("line_no").alias("shut_at"))
    pending = open_at.join(shut, KEY, "left").where("shut_at IS NULL OR open_at > shut_at").join(last_turn, "run_id").where("turn = last_turn")
    gap(pending, "NATIVE_MISSING_RESULT")
    both = calls.select(*KEY, F.col("f").alias("c")).join(results.select(*KEY, F.col("f").alias("r")), KEY, "full")
    both = stage(both.join(packets.groupBy("run_id").agg(F.first("adapter").alias("adapter")), "run_id"))
    gap(both.where("r IS NULL"), "NATIVE_MISSING_RESULT")
    gap(both.where("c IS NULL"), "NATIVE_ORPHAN_RESULT")

    read, place = F.col("c.kind") == "READ", F.when(F.col("c.kind") == "READ", F.col("c.given"))
    missing = F.col("r").isNull()
    at = F.when(missing, F.struct("c.line_no", "c.pos")).otherwise(F.greatest(F.struct("c.line_no", "c.pos"), F.struct("r.line_no", "r.pos")))
    nothing = F.array().cast("array<struct<source_id:string,url:string,title:string,rank:int>>")
    events = stage(both.where("c IS NOT NULL").select(
        "run_id", "turn", F.struct(missing.alias("late"), at["line_no"].alias("line_no"), at["pos"].alias("pos")).alias("at"), F.lit("event").alias("record_kind"),
        F.concat(F.lit("native-"), native_id("run_id", F.col("turn").cast("string"), "id")).alias("record_id"), F.col("c.kind").alias("type"), F.when(~read, F.col("c.given")).alias("query"), place.alias("location"),
        F.concat(F.lit("source-"), native_id(F.coalesce(place, F.concat("adapter", F.lit(":"), "id")))).alias("source_id"),
        F.when(F.startswith(place, F.lit("http")), "URL").when(place.isNotNull(), "FILE").otherwise("TOOL_RESULT").alias("source_kind"),
        F.when(missing, "UNKNOWN").when(F.col("r.failed"), "FAILED").otherwise("SUCCESS").alias("outcome"), F.when(read, F.col("r.content")).alias("summary"),
        F.when(~read, F.when(F.coalesce("r.failed", F.lit(True)), nothing).otherwise(F.col("r.links"))).alias("results"), F.col("id").alias("tool_call_id"), F.when(~missing, F.col("id")).alias("tool_result_id"),
    ))

    # Ends of turns: a claim and a receipt, or a gap
    ended = rows.where(F.col("line_no") == F.col("end"))
    spoke = item.where((F.col("type") == "item.completed") & (F.col("item.type") == "agent_message") & (F.coalesce("item.text", F.lit("")) != ""))
    candidate = spoke.groupBy("run_id", "turn").agg(F.max_by(F.struct(F.col("item.id").alias("id"), F.col("item.text").alias("text")), "line_no").alias("said"))
    ended = ended.join(candidate, ["run_id", "turn"], "left")
    bad = ~codex & ~((F.col("is_error").eqNullSafe(F.lit(False))) & F.col("subtype").eqNullSafe(F.lit("success")))
    own_id = _text(F.when(codex, F.col("said.id")).otherwise(F.col("uuid")))
    answer = F.when(codex, normalize_answer(_text(F.col("said.text")))).otherwise(_text(F.col("result")))
    ended = stage(ended.select("run_id", "turn", "adapter", "session", "line_no", bad.alias("bad"), own_id.alias("own_id"), answer.alias("answer")))
    gap(ended.where("bad"), "NATIVE_FAILED")
    gap(ended.where("NOT bad AND (own_id IS NULL OR answer IS NULL)"), "NATIVE_BOUNDARY")
    every = rows.select("run_id", "turn", "end").distinct().join(last_turn, "run_id")
    gap(every.where("end IS NULL AND (turn > 0 OR turn = last_turn)"), "NATIVE_BOUNDARY")
    silent = packets.select("run_id").distinct().join(last_turn, "run_id", "left_anti")
    gap(silent, "NATIVE_BOUNDARY")

    final = ended.where("NOT bad AND own_id IS NOT NULL AND answer IS NOT NULL").withColumn("local", native_id("run_id", F.col("turn").cast("string"), "own_id"))
    end_at = F.struct(F.lit(True).alias("late"), F.lit((1 << 62)).cast("bigint").alias("line_no"), F.lit(0).alias("pos"))
    claims = final.select(
        "run_id", "turn", end_at.alias("at"), F.lit("event").alias("record_kind"), F.concat(F.lit("claim-"), "local").alias("record_id"), F.lit("CLAIM").alias("type"),
        F.concat(F.lit("answer-"), native_id("own_id")).alias("source_id"), F.lit("UNKNOWN").alias("source_kind"), "answer")
    receipts = final.select(
        "run_id", "turn", end_at.alias("at"), F.lit("answer").alias("record_kind"), F.concat(F.lit("receipt-"), "local").alias("record_id"), F.concat(F.lit("answer-"), "local").alias("answer_id"),
        "session", "answer", answer_hash(F.col("answer")).alias("answer_hash"), (F.col("turn") > 0).alias("scope_declared"))
    broken = ended.where("bad").select("run_id").union(live.where("breaks").select("run_id")).distinct().withColumn("failed", F.lit(True))
    shut_last = every.where("turn = last_turn").select("run_id", F.col("end").isNotNull().alias("shut"))
    runs = packets.select("run_id").distinct().join(broken, "run_id", "left").join(shut_last, "run_id", "left").select(
        "run_id", F.when(F.col("failed"), "FAILED").when(F.coalesce("shut", F.lit(False)), "COMPLETED").otherwise("UNKNOWN").alias("lifecycle"))
    opened = runs.select("run_id", F.lit("run").alias("record_kind"), F.lit("RUNNING").alias("lifecycle")).unionByName(runs.select("run_id", F.lit("run").alias("record_kind"), "lifecycle"))
    records = events.unionByName(claims, allowMissingColumns=True).unionByName(receipts, allowMissingColumns=True).unionByName(opened, allowMissingColumns=True)
    mine = receipts.where("scope_declared").select("run_id", "turn", F.col("record_id").alias("receipt_id"))
    scope = mine.join(events.select("run_id", "turn", F.col("record_id").alias("event_id"), "at").union(claims.select("run_id", "turn", "record_id", "at")), ["run_id", "turn"])
    found = reduce(DataFrame.union, gaps).distinct()
    return Capture(records, scope.select("run_id", "receipt_id", "event_id", "at"), found, runs)
