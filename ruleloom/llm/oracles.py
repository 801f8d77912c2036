"""SQL that computes the rows of those queries that SQL can express."""

from __future__ import annotations

PLAIN = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1 = f"""with i as (select cast(item_id as varchar) as item, {PLAIN} as w from benchmark),
 iw as (select item, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as s, w from i where len(w) > 0),
 win as (select distinct item, w[s + 1 : s + least(10, len(w))] as words, least(10, len(w)) as n from iw),
 d as (select doc_id, {PLAIN} as w from documents),
 sizes as (select distinct n from win),
 dw as (select doc_id, n, s, w[s + 1 : s + n] as words
        from (select doc_id, n, w, unnest(range(0, len(w) - n + 1)) as s from d, sizes where len(w) >= n)),
 hit as (select doc_id, s, dw.n, item from dw join win using (words)),
 cover as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hit) group by 1),
 items as (select doc_id, count(distinct item) as n, string_agg(distinct item, ',' order by item) as names from hit group by 1)
 select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(items.n, 0) as n_items,
   sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
 from d left join cover using (doc_id) left join items using (doc_id)"""

SPACED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

OP3 = f"""with recursive d as (select doc_id, {SPACED} as w from documents),
 sh as (select distinct doc_id, array_to_string(w[s + 1 : s + 5], ' ') as x
        from (select doc_id, w, unnest(range(0, greatest(len(w) - 5, 0) + 1)) as s from d where len(w) > 0)),
 n as (select doc_id, count(*) as n from sh group by 1),
 shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b using (x) where a.doc_id <> b.doc_id group by all),
 link as (select a, b from shared join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
 walk(node, reached) as (select doc_id, doc_id from d union select walk.node, link.b from walk join link on link.a = walk.reached),
 root as (select node as doc_id, min(reached) as component_id from walk group by 1)
 select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from root left join n using (doc_id)"""

OP2 = """with d as (select doc_id, case when text is null then [] else string_split(text, chr(10)) end as ls from documents),
 l as (select doc_id, no, regexp_extract_all(ls[no + 1], '[^\\x20\\x09-\\x0D]+') as w
       from (select doc_id, ls, unnest(range(len(ls))) as no from d)),
 k as (select w, len(w) as n, min((doc_id, no)) as o from l where len(w) > 0 group by w),
 v as (select w, n, o, i, list_concat(w[1 : i], w[i + 2 : n]) as x from (select *, unnest(range(n)) as i from k where n >= 7)),
 asked as (select a.w as w from v a join v b on a.x = b.x and a.i = b.i and b.o < a.o where greatest(a.n, b.n) >= 8
   union all select a.w from v a join k b on a.x = b.w and b.o < a.o where greatest(a.n, b.n) >= 8
   union all select b.w from v a join k b on a.x = b.w and a.o < b.o where greatest(a.n, b.n) >= 8),
 near as (select distinct w from asked),
 fate as (select l.doc_id, l.no, (l.doc_id, l.no) <> k.o as copy, near.w is not null as near
          from l join k using (w) left join near using (w)),
 f as (select d.doc_id, len(ls) as n_lines, coalesce(list(no) filter (copy), []) as c, coalesce(list(no) filter (near and not copy), []) as r
       from d left join fate using (doc_id) group by all)
 select doc_id, n_lines, cast(len(c) as bigint) as n_copies, cast(len(r) as bigint) as n_near,
   sha256(array_to_string(list_filter(range(n_lines), lambda x: not list_contains(c, x) and not list_contains(r, x)), ',')) as kept_sha256
 from f"""

OP8 = """with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
 w as (select doc_id, s, md5(b[s + 1 : s + 400]) as m
       from (select doc_id, b, unnest(range(0, octet_length(b) - 399)) as s from d where octet_length(b) >= 400)),
 twice as (select m from w group by m having count(*) > 1),
 hit as (select doc_id, s, s - lag(s) over (partition by doc_id order by s) as step from w semi join twice using (m)),
 runs as (select doc_id, min(s) as lo, max(s) + 400 as hi
          from (select *, sum(case when step <= 400 then 0 else 1 end) over (partition by doc_id order by s) as run from hit) group by doc_id, run),
 cuts as (select *, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as before from runs),
 kept as (select doc_id, count(*) as n, sum(hi - lo) as removed, max(hi) as last, string_agg(hex(b[before + 1 : lo]), '' order by lo) as x
          from cuts join d using (doc_id) group by doc_id)
 select doc_id, octet_length(b) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(n, 0) as n_spans,
   sha256(case when n is null then b else unhex(x || hex(b[last + 1 : octet_length(b)])) end) as kept_sha256
 from d left join kept using (doc_id)"""

# crc32 of the bytes of "<doc_id>:<run>", by a table that is made here; letters from U+00C0 on are two bytes.
OP13 = """with steps as (select list(c order by b) as t from (
   select b, list_reduce(list_prepend(b, range(8)), lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
   from (select unnest(range(256)) as b))),
 r as (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
 u as (select doc_id, run, count(*) as n from r where length(run) >= 5 group by all),
 spelt as (select *, flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, ''),
          lambda c: case when ord(c) < 128 then [cast(ord(c) as bigint)] else [195, cast(ord(c) - 64 as bigint)] end)) as bytes from u),
 h as (select run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) as h from spelt, steps),
 m as (select n, case when h % 97 = 0 then run[: h % length(run)] || run[h % length(run) + 2 :] else run end as word from h),
 k as (select word, cast(sum(n) as bigint) as n from m where length(word) >= 5 group by 1 having sum(n) >= 3),
 v as (select word, n, i, word[: i] || word[i + 2 :] as x from (select *, unnest(range(length(word))) as i from k)),
 near as (select a.word as word, a.n as n, b.word as other, b.n as m from v a join v b on a.x = b.x and a.i = b.i and a.word <> b.word
   union select v.word, v.n, k.word, k.n from v join k on v.x = k.word
   union select k.word, k.n, v.word, v.n from v join k on v.x = k.word),
 best as (select word, count(*) as n_near, first(other order by m desc, other) as other, max(m) as m, any_value(n) as n from near group by 1),
 form as (select word, other as form, m as form_n from best where m >= 2 * n),
 walk as (with recursive w(word, reached) as (select word, form from form union all select w.word, form.form from w join form on w.reached = form.word) select * from w),
 root as (select word, reached as root from walk where reached not in (select word from form))
 select k.word as word, form, coalesce(root, k.word) as root, k.n as n, coalesce(n_near, 0) as n_near, form_n
 from k left join best using (word) left join form using (word) left join root using (word)"""

OP12 = """with e as (select vec_id, cast(case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end as bigint) as label,
     list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
   from embeddings where label is not null and vec_id is not null and embedding is not null
     and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
   from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
 p as (select anchor_id, other as positive_id, score as positive_score from s where same
   qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
 select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, other) as int) as rank,
   other as negative_id, positive_score, score as negative_score
 from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
 qualify rank <= 3"""

ORACLES: dict[str, str] = {
    "op1_decontaminate": OP1, "op2_line_dedup": OP2, "op3_minhash": OP3, "op8_suffix_dedup": OP8, "op12_hard_negatives": OP12, "op13_spelling_variants": OP13
}
