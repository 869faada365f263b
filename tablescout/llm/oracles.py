"""DuckDB SQL for the queries that SQL can express, each stated another way than the operator works."""

from __future__ import annotations

from tablescout.llm.secrets import BASE, SCOPE, WEAK
from tablescout.llm.sharding import TABLE_SIZE

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# All pairs that share a shingle, then everything that links reach.
JACCARD = f"""
with recursive w as (
  select doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}'), []) as ws from documents
), starts as (
  select doc_id, ws, unnest(case when len(ws) >= 5 then range(1, len(ws) - 3) when len(ws) > 0 then [1] else [] end) as s from w
), sh as (
  select distinct doc_id, md5(array_to_string(ws[s:s + 4], ' ')) as h from starts
), n as (
  select doc_id, count(*) as n from sh group by doc_id
), links as (
  select a.doc_id as a, b.doc_id as b from sh a join sh b on a.h = b.h and a.doc_id <> b.doc_id
  join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), reached as (
  select doc_id as id, doc_id as root from documents
  union
  select l.b as id, r.root as root from reached r join links l on l.a = r.id
)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, r.component_id
from documents d left join n on n.doc_id = d.doc_id
join (select id, min(root) as component_id from reached group by id) r on r.id = d.doc_id
"""

# Every window of every text, and the first text of each.
REPEATS = f"""
with w as (
  select doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) as ws from documents
), starts as (
  select doc_id, ws, unnest(range(0, len(ws) - 49)) as s from w where len(ws) >= 50
), windows as (
  select doc_id, s, md5(array_to_string(ws[s + 1:s + 50], ' ')) as h from starts
), firsts as (
  select h, min(doc_id) as f from windows group by h
), gone as (
  select distinct doc_id, unnest(range(s, s + 50)) as p from windows join firsts on firsts.h = windows.h where doc_id > f
), words as (
  select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as p from w
), kept as (
  select words.doc_id, string_agg(word, ' ' order by words.p) as kept, count(*) as n
  from words left join gone on gone.doc_id = words.doc_id and gone.p = words.p where gone.p is null group by words.doc_id
)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(kept.n, 0) as bigint) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from w left join kept on kept.doc_id = w.doc_id
"""


def _spans(number: int, kind: str, pattern: str, group: int, least: int, role: str) -> str:
    """Places of one pattern: what lies between the matches before, and those matches themselves."""
    p = pattern.replace("'", "''")
    return f"""
  select doc_id, {number} as k, '{kind}' as kind, '{role}' as role, s, s + length(m) as e from (
    select doc_id, m, v, sum(length(b)) over (partition by doc_id order by i)
      + coalesce(sum(length(m)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as s
    from (
      select doc_id, unnest(ms) as m, unnest(vs) as v, unnest(bs[1:len(ms)]) as b, generate_subscripts(ms, 1) as i from (
        select doc_id, regexp_extract_all(text, '{p}', 0) as ms, regexp_extract_all(text, '{p}', {group}) as vs,
          string_split_regex(text, '{p}') as bs from documents where regexp_matches(text, '{p}')
      )
    )
  ) where length(v) >= {least}"""


_PARTS = "\n  union all".join(_spans(i, *spec) for i, spec in enumerate((*BASE, *WEAK)))
_N_BASE = len(BASE)

SECRETS = f"""
with parts as ({_PARTS}
), shown as (
  select distinct doc_id, k, kind, s, e from parts where k < {_N_BASE}
  union
  select distinct a.doc_id, a.k, a.kind, a.s, a.e from parts a join parts b on a.doc_id = b.doc_id
  where a.k >= {_N_BASE} and (a.role = 'secret') <> (b.role = 'secret') and b.s <= a.e + {SCOPE} and a.s <= b.e + {SCOPE}
), lines as (
  select doc_id, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access, count(*) filter (where k = 2) as n_hex,
    coalesce(string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, k, e) filter (where k < {_N_BASE}), '') as base,
    string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, k, e) as spans
  from shown group by doc_id
)
select d.doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign, cast(coalesce(n_access, 0) as bigint) as n_access,
  cast(coalesce(n_hex, 0) as bigint) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join lines l on l.doc_id = d.doc_id
"""


def sharding(shards: list[str], size: int = TABLE_SIZE) -> str:
    """The table filled turn by turn: each step gives one slot to one shard."""
    names = ", ".join(f"'{s}'" for s in shards)
    n = len(shards)

    def number(text: str) -> str:
        return f"cast('0x' || substr(md5({text}), 1, 15) as bigint)"

    return f"""
with recursive orders as (
  select i, [({number("'offset:' || name")} % {size} + j * ({number("'skip:' || name")} % {size - 1} + 1)) % {size} for j in range({size})] as slots
  from (select unnest([{names}]) as name, unnest(range({n})) as i)
), turns as (
  select 0 as t, list_transform(range({size}), lambda x: -1) as owner
  union all
  select t + 1, list_transform(owner, lambda o, pos: case when pos - 1 = free then t % {n} else o end) from (
    select t, owner, list_filter(slots, lambda s: owner[s + 1] = -1)[1] as free from turns join orders on orders.i = t % {n} where t < {size}
  )
), final as (
  select unnest(owner) as o, unnest(range({size})) as slot from turns where t = {size}
)
select doc_id, cast(slot as integer) as slot, ([{names}])[o + 1] as shard
from documents join final on slot = {number("coalesce(cast(doc_id as varchar), '')")} % {size}
"""


# One level after the other, for all languages at once and then for their subroots; each leaf's way is followed step by step.
_STEP = "case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)), "
    f"lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, z: {_STEP})), 4294967295)")


def _leaf(text: str) -> str:
    def part(value: str) -> str:
        return f"coalesce(cast(strlen(cast({value} as varchar)) as varchar) || ':' || cast({value} as varchar), '-')"

    return "sha256(" + " || ".join(part(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MERKLE = f"""
with recursive leaves as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from (
    select doc_id, lang, {_leaf('text')} as leaf,
      case when {_CRC} % 3 = 0 then {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} end as other from documents)
), trees as (
  select lang, n, row_number() over (order by lang nulls first) - 1 as tree from (select distinct lang, n from leaves)
), nodes as (
  select t.tree, 0 as level, l.pos, l.leaf as hash, l.n from leaves l join trees t on t.lang is not distinct from l.lang
  union all
  select tree, level + 1, pos // 8, sha256(string_agg(hash, '' order by pos)), (any_value(n) + 7) // 8
  from nodes where n > 1 group by tree, level, pos // 8
), subroots as (
  select tree, level, hash from nodes where n = 1
), tops as (
  select 0 as level, tree as pos, hash, (select count(*) from subroots) as n from subroots
  union all
  select level + 1, pos // 8, sha256(string_agg(hash, '' order by pos)), (any_value(n) + 7) // 8 from tops where n > 1 group by level, pos // 8
), root as (
  select hash as root from tops where n = 1
), every as (
  select tree, level, pos, hash from nodes union all select -1, level, pos, hash from tops
), runs as (
  select tree, level, pos // 8 as run, list(hash order by pos) as hashes from every group by tree, level, pos // 8
), fold as (
  select l.doc_id, l.leaf, l.pos as first_pos, t.tree as own, t.tree, 0 as level, l.pos, coalesce(l.other, l.leaf) as hash, '' as proof, 0 as done
  from leaves l join trees t on t.lang is not distinct from l.lang
  union all
  select f.doc_id, f.leaf, f.first_pos, f.own,
    case when f.tree >= 0 and s.level = f.level then -1 else f.tree end,
    case when f.tree >= 0 and s.level = f.level then 0 else f.level + 1 end,
    case when f.tree >= 0 and s.level = f.level then f.tree else f.pos // 8 end,
    case when s.level is not distinct from f.level then f.hash else
      sha256(array_to_string(list_concat(list_concat(r.hashes[1:f.pos % 8], [f.hash]), r.hashes[f.pos % 8 + 2:]), '')) end,
    case when s.level is not distinct from f.level then f.proof else
      f.proof || array_to_string(list_concat(r.hashes[1:f.pos % 8], r.hashes[f.pos % 8 + 2:]), '') end,
    case when f.tree = -1 and f.level + 1 >= (select max(level) from tops) then 1 else 0 end
  from fold f left join subroots s on s.tree = f.tree join runs r on r.tree = f.tree and r.level = f.level and r.run = f.pos // 8
  where f.done = 0 and not (f.tree = -1 and f.level = (select max(level) from tops))
), ends as (
  select * from fold where tree = -1 and level = (select max(level) from tops)
)
select e.doc_id, e.leaf, s.hash as subroot, root.root, sha256(e.proof) as proof_sha256, e.hash as folded_root, e.hash = root.root as verified
from ends e join subroots s on s.tree = e.own, root
"""

# Every group with every kept term of its language, and all pairs of them.
DIVERGENCE = f"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as row, coalesce(text, '') as text from documents
), occ as (
  select lang, source, row,
    unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), kept as (
  select lang, term, count(*) as n from occ group by lang, term having count(distinct row) >= 30
), langs as (
  select lang, count(*) as v, sum(n) as total from kept group by lang
), groups as (
  select distinct lang, source from d
), counts as (
  select g.lang, g.source, k.term, k.n as lang_n, coalesce(c.n, 0) as n, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as total
  from groups g join kept k on k.lang = g.lang
  left join (select lang, source, term, count(*) as n from occ group by all) c on c.lang = g.lang and c.source = g.source and c.term = k.term
), shares as (
  select c.lang, c.source, c.term, c.n, 1 + 1000000000::hugeint * (c.n + 5) // (c.total + 5 * l.v) as p,
    1 + 1000000000::hugeint * (c.lang_n + 5) // (l.total + 5 * l.v) as q
  from counts c join langs l on l.lang = c.lang
), pairs as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), ranked as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all
  select lang, source, 'term', term, p - q from shares where n > 0 and p > q
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from ranked)
where part = 'pair' or rank <= 50
"""
