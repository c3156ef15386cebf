"""Queries of projections, on rows that the driver's conversations and events give."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import folds, project as L
from ..session import table
from .tables import TRANSCRIPT, transcript


def _codex(spark, d):
    """Raw rows with type and payload: messages, thoughts, calls and counters by turn."""
    t = table(spark, d, "conversations")
    k = F.col("turn") % 5
    outer = F.when(k.isin(0, 1, 2), "response_item").otherwise("event_msg")
    inner = F.when(k == 0, "message").when(k == 1, "reasoning").when(k == 2, "function_call").when(k == 3, "user_message").otherwise("turn_end")
    payload = F.struct(inner.alias("type"), "role", F.when(k == 2, "shell").alias("name"), F.when(k == 3, F.col("text")).alias("message"), F.when(k < 2, F.array(F.struct(F.lit("text").alias("type"), "text"))).alias("content"))
    raw = F.to_json(F.struct(F.concat(F.lit("t"), "turn").alias("timestamp"), outer.alias("type"), payload.alias("payload")))
    return t.select(F.col("conv_id").alias("path"), F.col("turn").alias("line_no"), F.parse_json(raw).alias("json"))


def _cut(text: str, size: int) -> str:
    t = f"trim(regexp_replace({text}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
    return f"case when length({t}) > {size} then substr({t}, 1, {size - 1}) || '…' else {t} end"


def _labels(spark, d):
    e = table(spark, d, "events")
    key = F.col("event_id") % 4
    details = F.struct(F.when(key == 0, F.col("event_type")).alias("query"), F.when(key == 1, F.concat(F.lit("\n  "), F.repeat("props", 20))).alias("command"), F.when(key == 2, F.lit("/a/b")).alias("path"), F.lit(1).alias("cmd"))
    rows = e.select("event_id", "event_type", F.parse_json(F.to_json(F.struct(details.alias("input")))).alias("json"))
    return rows.select("event_id", L.tool_label(F.col("event_type"), "json").alias("label"))


def _prompts(spark, d):
    t = transcript(spark, d)
    head = F.when(F.col("idx") % 3 == 0, F.lit("/run ")).when(F.col("idx") % 3 == 1, F.lit("<environment_context>\n</environment_context>")).otherwise("")
    return t.select("session", "idx", "role", F.concat(head, "text").alias("text"))


_PROMPTS = f"""{TRANSCRIPT}, p as (select session, idx, role, case idx % 3 when 0 then '/run ' when 1 then '<environment_context>' || chr(10) || '</environment_context>' else '' end || text as text from transcript)"""


def _previews(spark, d):
    t = transcript(spark, d)
    text = F.when(F.col("idx") % 4 == 0, F.concat(F.lit("files\n"), F.lit(L.REQUEST_HEAD), F.lit("\n"), "text")).when(F.col("idx") % 4 == 1, F.lit(" ")).otherwise(F.col("text"))
    return t.select("session", "idx", L.user_preview(text, F.when(F.col("session") % 2 == 0, 1)).alias("preview"))


def _images(spark, d):
    t = transcript(spark, d)
    text = F.concat("role", F.lit('<image path="/a&amp;b/'), "idx", F.lit('.png" name=[x]></image>'), F.when(F.col("idx") % 2 == 0, F.lit("<image path=/c />")).otherwise(""), F.lit("<image name=n/>"))
    return t.select("session", "idx", F.array_join(L.attachments(text), "|").alias("paths"))


def _without_images(spark, d):
    """Messages with images that name a path or none, below a list of files or not."""
    t = transcript(spark, d)
    files = F.when(F.col("idx") % 3 == 0, F.lit("# Files mentioned by the user:\n- a\n")).otherwise("")
    image = F.when(F.col("idx") % 2 == 0, F.lit("<image name=[x] path='/a b'>\n</image>")).otherwise("<image foo></image>")
    text = F.concat(files, F.lit("x"), image, F.lit("\n## my request for codex: \n"), "role", F.lit(" asks"))
    return t.select("session", "idx", L.without_attachments(text).alias("text"))


def _cwd(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "session").when(F.col("event_type") == "click", "turn").otherwise("other")
    cwd = F.when((F.col("event_id") % 5 != 0) & (F.col("user_id") % 4 != 0), F.concat(F.lit(" /"), "event_id")).otherwise(" ")
    return L.effective_cwd(e.select(F.col("user_id").alias("path"), F.col("event_id").alias("line_no"), F.when((F.col("user_id") % 3 == 0) & (kind == "turn"), "other").otherwise(kind).alias("kind"), cwd.alias("cwd")))


def _threads(spark, d):
    e = table(spark, d, "events")
    spawn = F.struct(F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string")).alias("parent_thread_id"), (F.col("event_id") % 4).alias("depth"), F.concat(F.when(F.col("event_id") % 5 != 0, F.lit("/")).otherwise(""), "event_type").alias("agent_path"))
    source = F.to_json(F.struct(F.struct(spawn.alias("thread_spawn")).alias("subagent")))
    return e.select("event_id", L.thread_source(source).alias("s")).where("s is not null").select("event_id", "s.*")


def _embedded(spark, d):
    t = transcript(spark, d)
    return t.select("session", "idx", L.embedded_request(F.concat(F.lit("review\nTRANSCRIPT START\n[1] system: a\n[2] user: "), "role", F.lit(" asks\nmore\n[3] assistant: no\nTRANSCRIPT END\nrest"))).alias("request"))


def _origins(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("provider"), F.col("o_orderkey").alias("id"))
    return L.provenance(o, o.where("id % 3 = 0").select("provider", "id", F.lit("imported").alias("conversion_origin")))


def _counters(spark, d):
    """A log a user, with a new session a day and nine ways to tell an event's usage, by event_id % 9.

    0: counter, input, response of the thread's total; 1, 2: counter and
    response, in either order; 3: a counter twice; 4: two counters, and the
    first again later; 5: a last usage that can't be read; 6: the runtime begins
    anew; 7: a response and its revision; 8: a compaction. Each fourth event
    begins one of three turns, and all but each eighth name a model there.
    """
    e = table(spark, d, "events").withColumns({"way": F.col("event_id") % 9, "used": (F.col("event_id") + 1) * 1_000, "day": F.to_date("ts"), "second": F.date_trunc("second", "ts")})
    order = W.partitionBy("user_id", "day").orderBy("event_id")
    e = e.withColumn("fresh", F.sum((F.col("way") == 6).cast("long")).over(order)).withColumn("opens", F.row_number().over(order) == 1)
    since = W.partitionBy("user_id", "day", "fresh").orderBy("event_id")
    e = e.withColumns({"high": F.sum(F.when(F.col("way") < 7, F.col("used"))).over(since), "calls": F.sum(F.when(F.col("way") < 7, 1)).over(since)})
    at = lambda seconds: F.date_format(F.col("second") + F.expr(f"interval {seconds} seconds"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    times = {seconds: at(seconds) for seconds in (0, 1, 9)}
    none, way = F.lit(None), F.col("way")

    def line(nth, when, kind, seconds=0, session=none, turn=none, model=none, response=none, total=(none, none), last=(none, none), has_last=False):
        # The three counts that aren't given are 0 where the others are.
        counts = {f"{p}_{c}": (given[k] if k < 2 else none if given[0] is none else F.when(given[0].isNotNull(), 0)) for p, given in (("total", total), ("last", last)) for k, c in enumerate(folds.COUNTERS)}
        return when, {"nth": F.lit(nth), "kind": F.lit(kind), "at": times[seconds], "has_last": F.lit(has_last), "session": session, "turn": turn, "model": model, "response": response, **counts}

    used, total, name = (F.col("used"), F.lit(1)), (F.col("high"), F.col("calls")), F.concat(F.lit("r"), "event_id")
    less = lambda pair: (pair[0] - 1, pair[1])
    lines = [
        line(0, F.col("opens"), "session", session=F.col("day")),
        line(1, F.col("event_id") % 4 == 0, "turn", turn=F.col("event_id") % 3, model=F.when(F.col("event_id") % 8 == 0, F.col("event_type"))),
        line(2, way == 2, "response", response=name, last=used),
        line(3, way.isin(0, 1, 2, 3, 6), "counter", total=total, last=used, has_last=True),
        line(3, way == 4, "counter", total=less(total), last=less(used), has_last=True),
        line(3, way == 5, "counter", total=total, has_last=True),
        line(4, way == 3, "counter", total=total, last=used, has_last=True),
        line(4, way == 4, "counter", total=total, last=(F.lit(1), F.lit(0)), has_last=True),
        line(5, way == 4, "counter", seconds=9, total=less(total), last=less(used), has_last=True),
        line(5, way == 0, "input"),
        line(6, way == 0, "response", response=name, total=total, last=used),
        line(6, way == 1, "response", response=name, last=used),
        line(6, way == 7, "response", response=name, last=less(used)),
        line(7, way == 7, "response", seconds=1, response=name, last=used),
        line(8, way == 8, "compaction", response=name, last=used),
    ]
    # An event is told apart by the numbers of its lines first, and what a line holds is computed for it alone.
    here = F.array_compact(F.array(*[F.when(when, k) for k, (when, _) in enumerate(lines)]))
    rows = e.withColumn("k", F.explode(here))

    def field(name: str, kind: str):
        held = {}
        for k, (_, fields) in enumerate(lines):
            if fields[name] is not none:
                held.setdefault(id(fields[name]), (fields[name], []))[1].append(k)  # values that lines share are computed in one place
        return F.coalesce(*[F.when(F.col("k").isin(ks), value) for value, ks in held.values()], none).cast(kind).alias(name)

    types = {"nth": "long", "has_last": "boolean", **{f"{p}_{c}": "long" for p in ("total", "last") for c in folds.COUNTERS}}
    told = rows.select(F.col("user_id").cast("string").alias("path"), "event_id", *[field(n, types.get(n, "string")) for n in lines[0][1]])
    return folds.counter_fold(told.withColumn("line_no", F.col("event_id") * 10 + F.col("nth")).drop("event_id", "nth"))


def _restarts(spark, d):
    """Counters that grow through a user's events and fall now and then; each fifth line names a model."""
    e = table(spark, d, "events")
    step = F.col("event_id") % 50
    zero = F.lit(0)
    rows = e.select(
        F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 5 == 0, "turn").otherwise("counter").alias("kind"), F.lit("s").alias("session"), F.lit("t").alias("turn"), F.col("event_type").alias("model"), F.lit(None).cast("string").alias("response"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.lit(False).alias("has_last"),
        *[(step * (k + 1) if c in ("input", "output") else zero).cast("long").alias(f"total_{c}") for k, c in enumerate(folds.COUNTERS)], *[F.lit(None).cast("long").alias(f"last_{c}") for c in folds.COUNTERS],
    )
    return folds.counter_fold(rows).where("warning is null").groupBy("path").agg(F.sum("input").alias("input"), F.sum("output").alias("output"))


def _revisions(spark, d):
    """An event's user and type name a reply that later events revise."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = e.select(
        F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("line_no"), F.concat("event_type", F.col("event_id") % 3).alias("message"), F.lit("").alias("request"), F.lit("m").alias("model"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"), F.lit(True).alias("has_split"), F.col("event_id").alias("input"), k.alias("output"), F.lit(0).cast("long").alias("cache_read"), F.lit(0).cast("long").alias("cache_write"), F.lit(0).cast("long").alias("write_5m"), F.lit(0).cast("long").alias("write_1h"),
    )
    return folds.by_day(folds.revision_fold(rows)).select("path", "date", "input", "output")


def _mixed(spark, d):
    """Raw rows of both forms: blocks of messages, and response items."""
    t = table(spark, d, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 8
    js = lambda *cs: F.to_json(F.struct(*cs))
    message = lambda role, content: js(F.struct(F.lit(role).alias("role"), content.alias("content")).alias("message"))
    item = lambda *cs: js(F.lit("response_item").alias("type"), F.struct(*cs).alias("payload"))
    lit = lambda v, name: F.lit(v).alias(name)
    raw = (
        F.when(k == 0, message("user", F.array(F.struct(lit("text", "type"), "text"))))
        .when(k == 1, message("assistant", F.array(F.struct(lit("thinking", "type"), lit(" ", "thinking")))))
        .when(k == 2, message("assistant", F.array(F.struct(lit("tool_use", "type"), lit("Read", "name"), F.struct(F.concat(F.lit("\n/a/"), "turn").alias("path")).alias("input")))))
        .when(k == 3, item(lit("message", "type"), "role", F.array(F.struct("text")).alias("content")))
        .when(k == 4, item(lit("function_call", "type"), lit("shell", "name"), lit('{"cmd": ["ls", "-l"]}', "arguments")))
        .when(k == 5, item(lit("function_call_output", "type"), js(F.concat(F.lit("took 1 s\nOutput:\n\n "), "text").alias("output")).alias("output")))
        .when(k == 6, js(lit("event_msg", "type"), F.struct(F.col("text").alias("message")).alias("payload")))
        .otherwise(message("user", F.lit("<environment_context>\n</environment_context>")))
    )
    return t.select(F.col("conv_id").alias("path"), F.col("turn").alias("line_no"), "role", F.parse_json(raw).alias("json"))


def _comments(spark, d):
    t = transcript(spark, d)
    head = F.when(F.col("idx") % 3 != 0, F.lit("# Diff comments:\n\n")).otherwise("no ")
    first = F.concat(F.lit("## Comment 4\nFile: browser:a/"), "idx", F.lit(" Lines: 3-9\nComment:\n "), "role", F.lit(" asks\n\n"))
    text = F.concat(head, F.when(F.col("idx") % 3 == 1, F.concat(first, F.lit("**Comment 5**\nno body here\n"))).otherwise(""), F.lit("\n## My request for Codex:\n\ndo "), "role", F.lit("\n<image></image>"))
    rows = L.diff_comments(t.select("session", "idx", text.alias("text"))).select("session", "idx", "request", F.explode("comments").alias("c"))
    return rows.select("session", "idx", "request", "c.*")


QUERIES = {
    "segments": lambda spark, d: L.segments(_mixed(spark, d)),
    "preview_text": lambda spark, d: _mixed(spark, d).select("path", "line_no", L.preview_text(F.col("role"), F.lit("summary")).alias("text")),
    "diff_comments": _comments,
    "project_event": lambda spark, d: L.codex_events(_codex(spark, d)).select("path", "line_no", "at", "role", "kind", "summary"),
    "tool_label": _labels,
    "generated_prompt": lambda spark, d: _prompts(spark, d).select("session", "idx", L.generated(F.col("text")).alias("generated"), L.internal_context(F.col("text")).alias("context")),
    "conversation_events": lambda spark, d: L.conversation(_prompts(spark, d)).select("session", "idx"),
    "first_prompt_title": lambda spark, d: L.first_prompts(_prompts(spark, d).select(F.col("session").alias("path"), F.col("idx").alias("line_no"), "role", "text")),
    "user_preview": _previews,
    "image_attachments": _images,
    "message_without_images": _without_images,
    "effective_cwd": _cwd,
    "thread_source": _threads,
    "embedded_request": _embedded,
    "provenance": _origins,
    "counter_fold": lambda spark, d: folds.by_day(_counters(spark, d)).select("path", "date", "model", "input", "output"),
    "counter_warnings": lambda spark, d: _counters(spark, d).where("warning is not null").select("path", "warning"),
    "counter_restarts": _restarts,
    "revision_fold": _revisions,
}

#: Events with the turn that holds, the model named last in it and altogether, and the first event of the day that a counter tells.
_TOLD = """e as (select *, date_trunc('second', ts) as second, event_id % 9 as way, cast(ts as date) as day, case when event_id % 4 = 0 then event_id % 3 end as begun, case when event_id % 8 = 0 then event_type end as named from events),
      t as (select *, last_value(begun ignore nulls) over (partition by user_id order by event_id) as turn, last_value(named ignore nulls) over (partition by user_id order by event_id) as latest from e),
      m as (select *, last_value(named ignore nulls) over (partition by user_id, turn order by event_id) as of_turn, min(case when way < 7 then event_id end) over (partition by user_id, day) as first_call from t)"""

_LINE = f"(case when length({{0}}) > 120 then substr({{0}}, 1, 119) || '…' else {{0}} end)".format("trim(regexp_replace(regexp_extract(text, '^\\s*([^\\n]*)', 1), '\\s+', ' ', 'g'))")

ORACLES = {
    "segments": f"""with r as (select conv_id as path, turn as line_no, role as who, text, (conv_id + turn) % 8 as k from conversations)
      select path, line_no, case when k in (0, 3) and (k = 0 or who in ('user', 'assistant')) and trim(text) <> '' then 'message' when k = 1 then 'reasoning' when k in (2, 4) then 'tool_call' when k = 5 then 'tool_result' else 'skip' end as segment,
        case when k in (0, 3) and trim(text) <> '' then case when k = 0 then 'user' when who in ('user', 'assistant') then who end end as role,
        case when k = 0 or k = 3 and who in ('user', 'assistant') then case when trim(text) <> '' then text end when k = 1 then '(加密推理)' when k = 2 then 'Read: /a/' || line_no when k = 4 then 'shell: ls -l' when k = 5 then {_LINE} end as text from r""",
    "preview_text": """with r as (select conv_id as path, turn as line_no, role, text, (conv_id + turn) % 8 as k from conversations)
      select path, line_no, case k when 1 then '(加密推理)' when 2 then case when role = 'assistant' then '' else '[Tool: Read]' end when 4 then 'summary' when 5 then 'summary' when 7 then '<environment_context>' || chr(10) || '</environment_context>' else text end as text from r""",
    "diff_comments": f"""with {TRANSCRIPT} select session, idx, 'do ' || role as request, 4::bigint as number, 'a/' || idx as context, role || ' asks' as body from transcript where idx % 3 = 1
      union all select session, idx, 'do ' || role, 5, '', '{L.NO_BODY}' from transcript where idx % 3 = 1 union all select session, idx, 'do ' || role, 1, '', '{L.NO_BODY}' from transcript where idx % 3 = 2""",
    "project_event": f"""select conv_id as path, turn as line_no, 't' || turn as at,
      case turn % 5 when 0 then role when 1 then 'reasoning' when 2 then 'tool_call' when 3 then 'user' else 'other' end as role,
      case turn % 5 when 0 then 'message' when 1 then 'reasoning' when 2 then 'function_call' when 3 then 'user_message' else 'event_msg/turn_end' end as kind,
      case turn % 5 when 1 then {_cut("text", 80)} when 2 then 'shell' when 4 then '' else {_cut("text", 120)} end as summary from conversations""",
    "tool_label": f"""with l as (select event_id, event_type as n, case event_id % 4 when 0 then event_type when 1 then {_cut("repeat(props, 20)", 120)} when 2 then '/a/b' end as d from events)
      select event_id, case when d is null then n else {_cut("n || ': ' || d", 120)} end as label from l""",
    "generated_prompt": f"with {_PROMPTS} select session, idx, starts_with(ltrim(text), '/') as generated, idx % 3 = 1 as context from p",
    "conversation_events": f"with {_PROMPTS} select session, idx from p where role in ('user', 'assistant') and not (role = 'user' and idx % 3 = 1)",
    "first_prompt_title": f"with {_PROMPTS} select session as path, {_cut('text', 100)} as title from p where role = 'user' and trim(text) <> '' and not starts_with(ltrim(text), '/') qualify row_number() over (partition by session order by idx) = 1",
    "user_preview": f"with {TRANSCRIPT}, v as (select session, idx, case when idx % 4 = 1 then '' else regexp_replace(text, '^\\s+|\\s+$', '', 'g') end as t from transcript) select session, idx, case when t <> '' then t when session % 2 = 0 then '[Image]' end as preview from v",
    "image_attachments": f"with {TRANSCRIPT} select session, idx, '/a&b/' || idx || '.png' || case when idx % 2 = 0 then '|/c' else '' end as paths from transcript",
    "message_without_images": f"""with {TRANSCRIPT} select session, idx, case when idx % 6 = 0 then role || ' asks' else case when idx % 3 = 0 then '# Files mentioned by the user:' || chr(10) || '- a' || chr(10) else '' end
      || 'x' || case when idx % 2 = 1 then '<image foo></image>' else '' end || chr(10) || '## my request for codex: ' || chr(10) || role || ' asks' end as text from transcript""",
    "effective_cwd": """select user_id as path, coalesce(max_by('/' || event_id, event_id) filter (event_type = 'click' and user_id % 3 <> 0 and event_id % 5 <> 0 and user_id % 4 <> 0),
      min_by('/' || event_id, event_id) filter (event_type = 'signup' and event_id % 5 <> 0 and user_id % 4 <> 0)) as cwd from events group by 1""",
    "thread_source": "select event_id, cast(user_id as varchar) as parent, event_id % 4 as depth, '/' || event_type as agent_path from events where event_id % 3 <> 0 and event_id % 4 >= 1 and event_id % 5 <> 0",
    "embedded_request": f"with {TRANSCRIPT} select session, idx, role || ' asks' || chr(10) || 'more' as request from transcript",
    "provenance": "select o_orderpriority as provider, o_orderkey as id, case when o_orderkey % 3 = 0 then 'imported' end as conversion_origin from orders",
    "counter_fold": f"""with {_TOLD}
      select cast(user_id as varchar) as path, strftime(case when way = 7 then second + interval 1 second else second end, '%Y-%m-%d') as date,
        case when way = 5 and first_call = event_id then '(unknown)' else coalesce(of_turn, latest, '(unknown)') end as model, cast(sum(1000 * (event_id + 1)) as bigint) as input, count(*) as output
      from m group by 1, 2, 3""",
    "counter_warnings": f"""with {_TOLD}
      select cast(user_id as varchar) as path, 'invalid last usage' as warning from m where way = 5 group by user_id
      union all select cast(user_id as varchar), 'unknown model' from m where way = 5 and first_call = event_id group by user_id
      union all select cast(user_id as varchar), 'counter reset' from m where way = 6 and first_call < event_id group by user_id
      union all select cast(user_id as varchar), 'unpaired counters and responses' from m group by user_id having count(*) filter (way = 7) > 0 and count(*) filter (way between 3 and 6) > 0""",
    "counter_restarts": """with d as (select user_id, event_id from events where event_id % 5 <> 0 qualify row_number() over (partition by user_id, date_trunc('second', ts), event_id % 50 order by event_id) = 1),
      c as (select user_id, event_id, event_id % 50 as step, lag(event_id % 50) over (partition by user_id order by event_id) as was from d),
      s as (select user_id, case when was is null or step < was then step else step - was end as more from c)
      select cast(user_id as varchar) as path, cast(sum(more) as bigint) as input, cast(sum(more) * 2 as bigint) as output from s group by 1 having sum(more) > 0""",
    "revision_fold": """with r as (select user_id, ts, event_id, cast(json_extract(props, '$.k') as bigint) as k, event_type || (event_id % 3) as message from events),
      w as (select *, max(ts) over (partition by user_id, message order by event_id rows between unbounded preceding and 1 preceding) as high from r),
      f as (select user_id, message, max_by(event_id, event_id) as event_id from w where high is null or ts > high group by 1, 2)
      select cast(f.user_id as varchar) as path, strftime(r.ts, '%Y-%m-%d') as date, cast(sum(f.event_id) as bigint) as input, cast(sum(k) as bigint) as output from f join r on f.event_id = r.event_id group by 1, 2""",
}
