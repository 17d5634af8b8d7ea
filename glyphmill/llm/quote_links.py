"""Chat formatting by quotation linking: messages without their quotes, tied to what they quote.

A line's quote level is the number of ``>`` that lead it, spaces between allowed. A passage is a run of lines of one
level. It is normalised (lower case, white space collapsed, empty lines left out) and hashed whole, by its paragraphs
(parts between empty lines) and by its lines, and so is what messages write without a quote mark. A quoted passage is
tied to the latest earlier message of its conversation that wrote it whole; if none did, its paragraphs are, and if no
paragraph is found, its lines. This holds for all levels. A message replies to that message of which it quotes the
most lines at the shallowest level that links anything, the latest among equals; a thread is what replies lead back
to, found by doubling: each round follows twice as many replies. Ordered by thread and turn, every message comes
after that it replies to.

The latest earlier writer of a hash is found by order, not by pairs: turns are cut into blocks, within a block a
window runs over what was written and quoted, and before it over the blocks' last writers. So a line that is common
in a large conversation makes no pairs of its messages and no group longer than a block or the count of blocks.
Everything is built-in functions.

Defined results: a null text stays null and links nothing; a text of quotes alone becomes empty. Empty lines link
nothing. A message never replies to itself or to a later one. Messages with a null conv_id or turn link nothing.
Repeated rows, and rows that share conv_id and turn, each keep their own text and share what either of them quotes.
An empty table gives no rows. Texts may be of any length. Columns of other names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import checkpointed, let, table

MARK = r"^(?: {0,3}>)+ ?"
_ANY = r"(?m)^ {0,3}>"
#: Turns in a block.
BLOCK = 4096


def _lines(text: Column) -> Column:
    """Array of (level, body) of a text's lines."""

    def parsed(line: Column) -> Column:
        mark = F.regexp_extract(line, MARK, 0)
        return F.struct((F.char_length(mark) - F.char_length(F.replace(mark, F.lit(">"), F.lit("")))).alias("level"), F.substr(line, F.char_length(mark) + 1, F.char_length(line)).alias("body"))

    return F.transform(F.split(text, "\n"), parsed)


def _normal(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(body), r"[ \x09-\x0D]+", " "))


def _units(messages: DataFrame) -> DataFrame:
    """conv_id, turn, message, level, passage, kind (0 passage, 1 paragraph, 2 line), hash and n, the count of lines."""
    lines = messages.select("conv_id", "turn", F.xxhash64("text").alias("message"), "text").dropDuplicates(["conv_id", "turn", "message"])
    lines = lines.select("conv_id", "turn", "message", F.posexplode(_lines(F.col("text"))).alias("i", "x"))
    lines = lines.select("conv_id", "turn", "message", "i", "x.level", _normal(F.col("x.body")).alias("line"))
    own = Window.partitionBy("conv_id", "turn", "message").orderBy("i")
    turns = ~F.col("level").eqNullSafe(F.lag("level").over(own))
    lines = lines.withColumns({"turns": turns.cast("int"), "breaks": (turns | (F.col("line") == "")).cast("int")})
    lines = lines.withColumns({"passage": F.sum("turns").over(own), "paragraph": F.sum("breaks").over(own)}).where(F.col("line") != "")
    of = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("long").alias("at")) for k, c in enumerate(("passage", "paragraph", "i"))])).alias("u")
    parts = lines.select("conv_id", "turn", "message", "level", "passage", of, F.struct("i", "line").alias("line"))
    whole = parts.groupBy("conv_id", "turn", "message", "level", "passage", "u").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return whole.select("conv_id", "turn", "message", "level", "passage", "u.kind", F.xxhash64(text).alias("hash"), F.size("lines").alias("n"))


def _origins(units: DataFrame) -> DataFrame:
    """Quoted units with ``origin``, the latest earlier turn of the conversation that wrote the same."""
    written = units.where("level = 0").select("conv_id", "hash", "turn").distinct()
    quoted = units.where("level > 0")
    block = F.floor(F.col("turn") / BLOCK).alias("block")
    asked = quoted.select("conv_id", "hash", "turn").distinct()
    events = written.select("conv_id", "hash", block, "turn", F.col("turn").alias("wrote")).union(asked.select("conv_id", "hash", block, "turn", F.lit(None).cast("long")))
    inside = Window.partitionBy("conv_id", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("conv_id", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = events.groupBy("conv_id", "hash", "block").agg(F.max("wrote").alias("last")).select("conv_id", "hash", "block", F.max("last").over(across).alias("before"))
    near = events.withColumn("near", F.max("wrote").over(inside)).where("wrote is null")
    found = near.join(before, ["conv_id", "hash", "block"]).select("conv_id", "hash", "turn", F.coalesce("near", "before").alias("origin")).where("origin is not null")
    return quoted.join(found, ["conv_id", "hash", "turn"])


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, origin and n, the count of lines quoted from it at that level."""
    messages = messages.where("conv_id is not null and turn is not null")
    marked = messages.where(F.col("text").rlike(_ANY)).select("conv_id").distinct()
    found = checkpointed(_origins(_units(messages.join(marked, "conv_id", "left_semi"))))
    passage = ["conv_id", "turn", "message", "passage"]
    best = found.groupBy(*passage).agg(F.min("kind").alias("kind"))
    return found.join(best, [*passage, "kind"]).groupBy("conv_id", "turn", "level", "origin").agg(F.sum("n").alias("n"))


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, thread, max_level, n_quoted, links ("level:origin", by level, then origin) and text."""
    messages = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    all_ = links(messages).groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("level", "origin", "n"))).alias("l"))
    order = F.array_max(F.transform("l", lambda x: F.struct((-x["level"]).alias("level"), x["n"].alias("n"), x["origin"].alias("origin"))))
    written = F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["level"], x["origin"])), ",")
    replies = checkpointed(all_.select("conv_id", "turn", order["origin"].alias("reply_to"), written.alias("links")))
    roots, open_ = replies.select("conv_id", "turn", F.col("reply_to").alias("root")), replies.count()
    while open_:
        up = roots.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"))
        roots = checkpointed(roots.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        open_ = roots.where("moved").count()
        roots = roots.drop("moved")
    known = replies.join(roots, ["conv_id", "turn"])
    lines = let(
        _lines(F.col("text")),
        lambda x: F.struct(
            F.array_max(F.transform(x, lambda y: y["level"])).alias("max_level"),
            F.size(F.filter(x, lambda y: y["level"] > 0)).cast("long").alias("n_quoted"),
            F.array_join(F.transform(F.filter(x, lambda y: y["level"] == 0), lambda y: y["body"]), "\n").alias("own"),
        ),
    )
    plain = F.struct(F.lit(0).alias("max_level"), F.lit(0).cast("long").alias("n_quoted"), F.col("text").alias("own"))
    cut = messages.withColumn("l", F.when(F.col("text").rlike(_ANY), lines).otherwise(plain))
    out = cut.join(known, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "reply_to", F.coalesce("root", "turn").alias("thread"), F.col("l.max_level").alias("max_level"), F.col("l.n_quoted").alias("n_quoted"), F.coalesce("links", F.lit("")).alias("links"), F.col("l.own").alias("text"))


def ordered(messages: DataFrame) -> DataFrame:
    """The linked messages in reply order: by conversation, thread and turn."""
    return linked(messages).orderBy("conv_id", "thread", "turn")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "conversations"))


SQL = r"""
with recursive m as (select row_number() over () as k, conv_id, turn, role, text from conversations),
x as (select k, conv_id, turn, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from m),
y as (select *, regexp_extract(line, '^(?: {0,3}>)+ ?') as mark from x),
z as (select k, conv_id, turn, i, length(mark) - length(replace(mark, '>', '')) as level, substr(line, length(mark) + 1) as body from y),
n as (select *, trim(regexp_replace(lower(body), '[ \t\n\x0B\f\r]+', ' ', 'g')) as norm, level is distinct from lag(level) over (partition by k order by i) as turns from z),
q as (select *, sum(turns::int) over w as passage, sum((turns or norm = '')::int) over w as paragraph from n window w as (partition by k order by i)),
p as (select *, unnest([0, 1, 2]) as kind, unnest([passage, paragraph, i]) as place from q where norm <> ''),
u as (select k, conv_id, turn, level, passage, kind, place, string_agg(norm, chr(10) order by i) as norm, count(*) as n from p group by all),
f as (select a.k, a.conv_id, a.turn, a.level, a.passage, a.kind, a.place, a.n, max(b.turn) as origin from u a join u b
    on a.conv_id = b.conv_id and a.norm = b.norm and b.level = 0 and b.turn < a.turn where a.level > 0 group by all),
h as (select *, min(kind) over (partition by k, passage) as best from f),
d as (select distinct on (conv_id, turn, text) k from m),
l as (select conv_id, turn, level, origin, sum(n) as n from h where kind = best and k in (select k from d) group by all),
r as (select conv_id, turn, first(origin order by level, n desc, origin desc) as reply_to, string_agg(level || ':' || origin, ',' order by level, origin) as links from l group by all),
t as (select conv_id, turn, reply_to as root from r union select t.conv_id, t.turn, r.reply_to from t join r on r.conv_id = t.conv_id and r.turn = t.root),
g as (select conv_id, turn, min(root) as root from t group by all),
a as (select k, max(level)::integer as max_level, count(*) filter (level > 0) as n_quoted, coalesce(string_agg(body, chr(10) order by i) filter (level = 0), '') as own from z group by k)
select m.conv_id, m.turn, m.role, r.reply_to, coalesce(g.root, m.turn) as thread, coalesce(a.max_level, 0)::integer as max_level,
  coalesce(a.n_quoted, 0)::bigint as n_quoted, coalesce(r.links, '') as links, a.own as text
from m left join a using (k) left join r on r.conv_id = m.conv_id and r.turn = m.turn left join g on g.conv_id = m.conv_id and g.turn = m.turn
"""
