"""DuckDB SQL of the length split, the three ordered merges and the whole of cue spotting, by recursive CTEs."""

from __future__ import annotations

LONG = "len(ws) > 1 and chars > 84"
CHARS = "list_sum(list_transform(ws, lambda x: length(x.w) + 1)) - 1 + case when dash then 2 else 0 end"


def split_ctes(turns: str) -> str:
    """``turns`` (CTEs with parted and turns) to groups: one row a group after the length split."""
    return f"""{turns}, lists as (
  select p.video_id, p.part_id, list({{'pos': p.pos, 'w': p.w, 's': p.s_ms, 'e': p.e_ms}} order by p.s_ms, p.pos) as ws, any_value(t.turn) as turn, any_value(t.dash) as dash
  from parted p join turns t using (video_id, part_id) group by p.video_id, p.part_id
), sized as (select *, {CHARS} as chars from lists
), halves as (
  select video_id, ws, turn, dash, chars from sized
  union all
  select video_id, ws, turn, dash, {CHARS} as chars from (
    select video_id, unnest([ws[1:cut], ws[cut + 1:]]) as ws, unnest([turn, false]) as turn, unnest([dash, false]) as dash from (
      select *, greatest(1, least(len(ws) - 1, coalesce(list_min(list_transform(list_filter(range(0, len(ws) - 1), lambda i: ws[i + 1].w like '%,'), lambda i: {{'far': abs(i - len(ws) // 2), 'i': i}})).i + 1, len(ws) // 2))) as cut
      from halves where {LONG}))
), groups as (
  select video_id, ws[1].s as start_ms, ws[-1].e as end_ms, cast(chars as integer) as chars, cast(len(list_filter(ws, lambda x: regexp_matches(x.w, '[.!?]["''”’)\\]]*$'))) as integer) as sentences,
         ws[-1].w like '%?' as ends_q, turn, dash, ws[1].pos as first_pos, ws[-1].pos as last_pos, false as compromise
  from halves where not ({LONG})
)"""


def fold(name: str, source: str, merges: str, crowds: str = "false") -> str:
    """CTEs that fold ``source`` in order into ``name``; in the conditions p is the last kept group and g the next one."""
    fields = "start_ms, end_ms, chars, sentences, ends_q, turn, dash, first_pos, last_pos, compromise"
    return f"""{name}_in as (
  select video_id, row_number() over (partition by video_id order by start_ms, first_pos) as i, count(*) over (partition by video_id) as n, struct_pack({', '.join(f'{x} := {x}' for x in fields.split(', '))}) as g from {source}
), {name}_walk as (
  select video_id, i, n, g as p, cast(null as typeof_g) as done from {name}_in where i = 1
  union all
  select x.video_id, x.i, x.n,
         case when {merges} then struct_pack(start_ms := p.start_ms, end_ms := g.end_ms, chars := p.chars + 1 + g.chars - case when g.dash then 2 else 0 end, sentences := p.sentences + g.sentences, ends_q := g.ends_q, turn := p.turn, dash := p.dash, first_pos := p.first_pos, last_pos := g.last_pos, compromise := p.compromise) else g end,
         case when {merges} then null else struct_pack(start_ms := p.start_ms, end_ms := p.end_ms, chars := p.chars, sentences := p.sentences, ends_q := p.ends_q, turn := p.turn, dash := p.dash, first_pos := p.first_pos, last_pos := p.last_pos, compromise := p.compromise or {crowds}) end
  from {name}_walk w join {name}_in x on x.video_id = w.video_id and x.i = w.i + 1
), {name} as (
  select video_id, unnest(done) from {name}_walk where done is not null union all select video_id, unnest(p) from {name}_walk where i = n
)""".replace("typeof_g", "struct(start_ms bigint, end_ms bigint, chars integer, sentences integer, ends_q boolean, turn boolean, dash boolean, first_pos integer, last_pos integer, compromise boolean)")


SAFE = "(p.chars + 1 + g.chars <= 84 and g.end_ms - p.start_ms <= 6000 and g.start_ms - p.end_ms <= 700 and not p.ends_q and not g.turn and p.sentences < 2)"
SHORT = f"(g.end_ms - g.start_ms < 1200 and {SAFE})"
INSTANT = "(g.start_ms - p.start_ms < 40)"
CROWDS = "(g.start_ms - p.start_ms < 1200)"
COLUMNS = "video_id, start_ms, end_ms, chars, sentences, ends_q, turn, dash, first_pos, last_pos, compromise"


def merged_ctes(turns: str) -> str:
    base = split_ctes(turns)
    return f"{base}, {fold('shorts', 'groups', SHORT)}, {fold('instants', 'shorts', INSTANT)}, {fold('floors', 'instants', f'({CROWDS} and {SAFE})', CROWDS)}"


def spot_ctes(turns: str) -> str:
    """All of cue spotting, as far as text, times and word statistics."""
    return f"""{merged_ctes(turns)}, numbered as (
  select *, row_number() over (partition by video_id order by start_ms, first_pos) as cue_id from floors
), told as (
  select n.video_id, n.cue_id, n.dash, n.compromise, w.s_ms, w.e_ms, w.w, w.pos, w.e_ms - w.s_ms < 50 as short from numbered n join words w on w.video_id = n.video_id and w.pos between n.first_pos and n.last_pos
), islands as (
  select *, row_number() over o - sum(cast(short as int)) over o as island from told window o as (partition by video_id, cue_id order by s_ms, pos)
), runs as (select video_id, cue_id, island, count(*) as n, sum(cast(short as int)) as d, min(e_ms - s_ms) as m from islands group by all
), stats as (select video_id, cue_id, cast(sum(n) as bigint) as words, cast(sum(d) as bigint) as degenerate, cast(max(d) as bigint) as degenerate_run, min(m) as min_word_dur_ms from runs group by all
), cue as (
  select video_id, cue_id, min(s_ms) as start_ms, greatest(last(e_ms order by s_ms, pos), min(s_ms)) as end_ms, case when any_value(dash) then '— ' else '' end || string_agg(w, ' ' order by s_ms, pos) as text, any_value(compromise) as compromise from told group by all
), nexts as (select *, lead(start_ms) over (partition by video_id order by start_ms, cue_id) as nxt from cue
), limits as (select *, coalesce(least(nxt - 80, end_ms + 1000), end_ms + 1000) as lim from nexts
), firsts as (select *, case when lim < end_ms then greatest(lim, start_ms + 1200) else least(lim, start_ms + 6000) end as e1 from limits
), led as (select *, greatest(least(greatest(e1, start_ms + 1200), coalesce(nxt, greatest(e1, start_ms + 1200))), start_ms + 40) as e2 from firsts)
select l.video_id, l.cue_id, l.start_ms, case when duration_ms > 0 and e2 > duration_ms then greatest(duration_ms, l.start_ms + 40) else e2 end as end_ms, text, compromise, words, degenerate, degenerate_run, min_word_dur_ms
from led l join stats using (video_id, cue_id) join videos using (video_id)"""


def wrap_ctes(source: str, keys: str) -> str:
    """CTE ``wrapped`` with the text of ``source`` in at most two scored lines, or wrapped greedily."""
    top, bottom = "array_to_string(ws[1:i], ' ')", "array_to_string(ws[i + 1:], ' ')"
    score = f"abs(length({top}) - length({bottom})) + case when length({top}) > length({bottom}) then 3 else 0 end - case when regexp_matches({top}, '[.?!]$') then 30 when regexp_matches({top}, '[,;:]$') then 12 else 0 end"
    return f"""cut as (
  select {keys}, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') as ws from {source}
), joined as (select *, array_to_string(ws, ' ') as whole from cut
), choice as (
  select *, case when len(ws) > 1 and length(whole) <= 85 then list_min(list_filter(list_transform(range(1, len(ws)), lambda i: {{'score': {score}, 'i': i, 'top': {top}, 'bottom': {bottom}}}), lambda o: length(o.top) <= 42 and length(o.bottom) <= 42)) end as best from joined
), wrapped as (
  select {keys}, case when length(whole) <= 42 then whole when best is not null then best.top || chr(10) || best.bottom
    else list_reduce(ws, lambda acc, w: acc || case when length(string_split(acc, chr(10))[-1]) + 1 + length(w) <= 42 then ' ' else chr(10) end || w) end as wrapped from choice
)"""
