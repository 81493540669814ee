"""Chat formatting by event-sourced reconstruction, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Marks of the template.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""``\`` doubled, then ``<|`` as ``<\|``: the result has no ``<|``, so no mark can appear in it."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    """A doubled backslash before an n stays one: they are set aside first."""
    aside = F.replace(role, F.lit("\\\\"), F.lit("\\<|"))
    lines = F.replace(F.replace(aside, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<||"))
    return F.replace(F.replace(lines, F.lit("\\<|"), F.lit("\\")), F.lit("<||"), F.lit("<|"))


def rebuild_messages(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, position, message_id, role, text) of a log (conv_id, seq, message_id, kind, role, payload).

    Kinds, folded in the order of seq (ties: kind, then payload): ``start`` opens a message, ``delta`` appends its
    payload, ``edit`` replaces the text, ``regenerate`` empties it for the deltas that follow, ``delete`` removes the
    message unless something follows. Unknown kinds and null message ids are left out; a null payload is empty. A
    message's place is that of its first event, its role the last that isn't null (none: empty). Repeated events
    count as often as they are there. Only what follows a message's last replacement is joined, so the fold is
    linear in its events. The log is dealt by conversation once, and all that follows keeps that partitioning. An empty
    log gives no messages; a null conv_id is a conversation, other columns are not read.
    """
    kinds = ("start", "delta", "edit", "regenerate", "delete")
    event = F.struct("seq", "kind", F.coalesce("payload", F.lit("")).alias("payload"), "role")
    log = events.where(F.col("kind").isin(*kinds) & F.col("message_id").isNotNull())
    folded = log.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(event)).alias("e"))
    reset = F.expr("aggregate(sequence(1, size(e)), 0, (a, k) -> if(e[k - 1].kind in ('edit', 'regenerate', 'delete'), k, a))")
    folded = folded.withColumn("at", reset)
    tail = F.expr("slice(e, greatest(at, 1), size(e))")
    text = F.array_join(F.transform(F.filter(tail, lambda x: x["kind"].isin("start", "delta", "edit")), lambda x: x["payload"]), "")
    role = F.expr("element_at(array_append(filter(transform(reverse(e), x -> x.role), r -> r is not null), ''), 1)")
    gone = F.expr("at > 0 and at = size(e) and e[size(e) - 1].kind = 'delete'")
    return folded.where(~gone).select("conv_id", F.col("e")[0]["seq"].alias("position"), "message_id", role.alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): each conversation as one text, turns by position (ties: role, then text, as they are unescaped).

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n`` with role and text escaped. loss_mask has (start, length, within)
    for each turn: the code points, from 1, of what is learnt in ``formatted`` and in the turn; a turn of another role than
    assistant has the length 0. Null roles and texts are empty; a null conv_id is a conversation of its own. Places are
    running sums, so the work is linear in the turns but for their sorting. A conversation is one value of the result
    and so is held by one task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = messages.select("conv_id", "position", role.alias("role"), text.alias("text"), _escape_role(role).alias("head"), escape(text).alias("body"))
    within = F.length("head") + len(TURN_START) + 2
    size = within - 1 + F.length("body") + len(TURN_END) + 1
    order = Window.partitionBy("conv_id").orderBy("position", "role", "text")
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    learnt = F.struct((before + within).cast("long").alias("start"), F.when(F.col("role") == "assistant", F.length("body")).otherwise(0).alias("length"), within.cast("int").alias("within"))
    turn = F.concat(F.lit(TURN_START), "head", F.lit("\n"), "body", F.lit(TURN_END + "\n"))
    placed = turns.select("conv_id", F.struct(F.row_number().over(order).alias("k"), turn.alias("turn"), learnt.alias("learnt")).alias("t"))
    gathered = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return gathered.select("conv_id", F.array_join("t.turn", "").alias("formatted"), F.col("t.learnt").alias("loss_mask"))


def split_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as they are written."""
    return F.transform(F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30), lambda t: F.concat(F.lit(TURN_START), t))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    turns = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    role = lambda t: F.substring_index(t, "\n", 1)
    return F.transform(turns, lambda t: F.struct(_unescape_role(role(t)).alias("role"), unescape(t.substr(F.length(role(t)) + 2, F.length(t) - F.length(role(t)) - 2 - len(TURN_END))).alias("text")))


def digests(rendered: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns by parsing, learnt text by its mask."""
    turns = F.array_join(F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.zip_with(split_turns(F.col("formatted")), "loss_mask", lambda t, m: unescape(t.substr(m["within"], m["length"])))
    read = rendered.select("conv_id", F.size("loss_mask").cast("long").alias("n_turns"), turns.alias("t"), F.array_join(learnt, "").alias("l"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2("t", 256).alias("turns_sha256"), F.length("l").cast("long").alias("loss_chars"), F.sha2("l", 256).alias("loss_sha256"), "formatted_chars")


#: Code points of a streamed delta.
DELTA = 240


def events_of(conversations: DataFrame) -> DataFrame:
    """A log (conv_id, seq, message_id, kind, role, payload) whose fold gives the rows of ``conversations`` (conv_id, turn, role, text).

    It has all that a stream has: texts come in deltas of DELTA code points; of three messages, told by a hash, one comes as
    it is, one is first streamed as a draft and regenerated, one is posted as a draft and edited. Messages are numbered in
    the order of turn (nulls last), role and text; rows that repeat all three stay messages of their own. Rows are dealt by
    conversation here, and all that follows keeps that partitioning: one shuffle in all.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    dealt = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).repartition("conv_id")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    named = dealt.withColumn("message", F.row_number().over(order).cast("long"))
    case = F.pmod(F.xxhash64("conv_id", "message"), F.lit(3))
    event = lambda kind, payload: F.struct(F.lit(kind).alias("kind"), F.when(F.lit(kind == "start"), F.col("role")).alias("role"), payload.cast("string").alias("payload"))
    deltas = lambda t: F.transform(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)), lambda p: event("delta", p))
    none = F.lit(None)
    draft, final = deltas(F.reverse("text")), deltas(F.col("text"))
    start = F.array(event("start", none))
    whole = F.when(case == 0, F.concat(start, final)).when(case == 1, F.concat(start, draft, F.array(event("regenerate", none)), final)).otherwise(F.concat(start, draft, F.array(event("edit", F.col("text")))))
    log = named.select("conv_id", "message", F.posexplode(whole).alias("step", "e"))
    seq = F.col("message") * (1 << 40) + F.col("step")
    return log.select("conv_id", seq.alias("seq"), F.col("message").cast("string").alias("message_id"), "e.kind", "e.role", "e.payload")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) as a log, rebuilt from it and rendered: (conv_id, formatted, loss_mask).

    Turns go by number (null: last), those of one number by role, then text. Null roles and texts are empty, a null conv_id
    is a conversation. Other columns are not read. An empty table gives no rows.
    """
    return render(rebuild_messages(events_of(conversations)))
