"""The queries of this subpackage and the SQL for those that SQL can express.

Where SQL can say only some of a query's columns, these are a query of their own (``digest_…``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_ann, chat_windows, class_lm, conversation_repair, fill_in_middle, fingerprints, language_id, minhash_dedup, packing, personal_data, sentencepiece_codec, token_counts, toxicity


def digest_op4_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base scores of op4."""
    return class_lm.op4_class_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def digest_op5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns and learned texts that op5 reads back."""
    return chat_windows.op5_chat_windows(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def digest_op6_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts of op6."""
    return fingerprints.op6_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def digest_op9_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom op9's index finds when nothing is left out by chance: a reach that no vector is beyond, as the SQL is exact."""
    vectors = additive_ann.read_table(spark, sf_dir, "embeddings")
    found = additive_ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), reach=None)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id")


def digest_op13_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op13."""
    return personal_data.op13_personal_data(spark, sf_dir).drop("spans", "n_spans")


QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_language_id": language_id.op2_language_id,
    "op3_near_duplicates": minhash_dedup.op3_near_duplicates,
    "op4_class_lm": class_lm.op4_class_lm,
    "op5_chat_windows": chat_windows.op5_chat_windows,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_nearest": additive_ann.op9_nearest,
    "op10_packing": packing.op10_packing,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_personal_data": personal_data.op13_personal_data,
    "digest_op4_base": digest_op4_base,
    "digest_op5_turns": digest_op5_turns,
    "digest_op6_edits": digest_op6_edits,
    "digest_op9_ranks": digest_op9_ranks,
    "digest_op13_base": digest_op13_base,
}

_WORDS = "regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
_BITS = "list_reduce(list_prepend(xor(h,b), range(8)), lambda x, i: CASE WHEN x%2=1 THEN xor(x//2, 3988292384) ELSE x//2 END)"


def _crc32(key: str) -> str:
    """crc32 of an ASCII string expression."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({key},''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: {_BITS}), 4294967295)"


_CRC32 = _crc32("CAST(doc_id AS VARCHAR)")


def _ways(*ways: tuple[str, str, str, str]) -> str:
    """The least (cost, audit) of several: state gone on from, cost, letter, text added."""
    return "list_min([" + ", ".join(f"{{'c': {z}.c+{cost}, 'a': {z}.a||'{letter}', 'x': {z}.x||{text}}}" for z, cost, letter, text in ways) + "])"


def _inserted(z: str) -> str:
    """State ``z`` after insertions: of a user turn, then of an assistant turn."""
    user = _ways(("zu", "0", "", "''"), *[(f"z{q}", "3", "I", "'user:'||chr(10)") for q in "0sa"])
    return {"u": user, "a": _ways(("za", "0", "", "''"), ("(" + user + ")", "3", "I", "'assistant:'||chr(10)"))}.get(z, f"z{z}")


def _turn(state: str, before: str, role: str) -> str:
    """State after a turn: deleted, or kept or given a role from the states before."""
    own, cut = f"CASE WHEN i='{state}' THEN 0 ELSE 900000 END", "CASE WHEN fault='t' THEN 3 ELSE 0 END+CASE WHEN fault IN ('b','d') THEN 900000 ELSE 0 END"
    kept = [(f"y{p}", f"{own}+{cut}", "K", "role||':'||text||chr(10)") for p in before]
    given = [(f"y{p}", f"3+{cut}", "R", f"'{role}:'||text||chr(10)") for p in before] if role else []
    return _ways((f"y{state}", "4", "D", "''"), *kept, *given)

_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

ORACLE_SQL = {
    "op3_near_duplicates": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w)=0 THEN [] WHEN len(w)<5 THEN [array_to_string(w,' ')] ELSE list_distinct(list_transform(range(1,len(w)-3), lambda i: array_to_string(w[i:i+4],' '))) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM s), i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM e a JOIN e b ON a.x=b.x AND a.doc_id<b.doc_id GROUP BY 1,2),
l AS (SELECT u, v FROM i JOIN s a ON a.doc_id=u JOIN s b ON b.doc_id=v WHERE 100*n>=85*(len(a.s)+len(b.s)-n)), b AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, b.v FROM r JOIN b ON b.u=r.c),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id=component_id AS kept FROM s JOIN m USING (doc_id)""",
    "digest_op4_base": f"""WITH w AS (SELECT doc_id, {_CRC32}%10=0 AS held_out, list_append({_WORDS}, '') AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS x FROM w), c AS (SELECT x, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), z AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c.c,0)+0.1::DOUBLE)/(n+0.1::DOUBLE*(v+1)))),4) AS base_score
FROM t LEFT JOIN c USING (x), z GROUP BY doc_id, held_out, n""",
    "digest_op5_turns": """WITH t AS (SELECT conv_id, turn, role, coalesce(text,'') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role||chr(10)||text||chr(10), '' ORDER BY turn) AS x, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role='assistant'), '') AS y FROM t GROUP BY 1)
SELECT conv_id, n_turns, sha256(x) AS turns_sha256, length(y) AS loss_chars, sha256(y) AS loss_sha256 FROM a""",
    "digest_op6_edits": """WITH d AS (SELECT doc_id, coalesce(text,'') AS t FROM documents), n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS f FROM d)
SELECT doc_id, n AS n_chars, sha256(substr(t, 1, n-n//2)||substr(f, 1, n//2)) AS edited_sha256 FROM n""",
    "op11_fill_in_middle": """WITH t AS (SELECT doc_id, coalesce(text,'') AS x, sha256('42:'||doc_id) AS h FROM documents),
u AS (SELECT doc_id, x, list_transform(regexp_extract_all(x, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+'), lambda s: length(s)) AS l, list_transform(range(4), lambda i: CAST('0x'||substr(h, 8*i+1, 8) AS BIGINT)) AS h FROM t),
c AS (SELECT *, len(l) AS n, least(h[1]%(len(l)+1), h[2]%(len(l)+1)) AS i, greatest(h[1]%(len(l)+1), h[2]%(len(l)+1)) AS j FROM u),
f AS (SELECT doc_id, n, x, CASE WHEN x='' OR contains(x,'<P>') OR contains(x,'<S>') OR contains(x,'<M>') OR h[3]%100>=50 THEN 'plain' WHEN h[4]%100<80 THEN 'spm' ELSE 'psm' END AS form, CAST(coalesce(list_sum(l[:i]),0) AS BIGINT) AS p, CAST(coalesce(list_sum(l[i+1:j]),0) AS BIGINT) AS m FROM c)
SELECT doc_id, n, form, CASE WHEN form<>'plain' THEN p END AS prefix_chars, CASE WHEN form<>'plain' THEN m END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>'||substr(x,1,p)||'<S>'||substr(x,p+m+1)||'<M>'||substr(x,p+1,m) ELSE '<S>'||substr(x,p+m+1)||'<P>'||substr(x,1,p)||'<M>'||substr(x,p+1,m) END) AS output_sha256, sha256(x) AS restored_sha256 FROM f""",
    "op12_conversation_repair": f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role,' ') AS role, coalesce(text,' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR),' ')||':'||coalesce(CAST(turn AS VARCHAR),' ')")}%20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k=4 THEN 'user' ELSE role END AS role, CASE WHEN k=1 THEN '' WHEN k=2 THEN regexp_replace(text,'[.!?]','','g') ELSE text END AS text, unnest(range(CASE WHEN k=3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k<>0),
o AS (SELECT *, left(role,1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n FROM d),
f AS (SELECT conv_id, turn, role, text, i, n, CASE WHEN NOT regexp_matches(text,'[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n)>1 THEN 'd' WHEN NOT regexp_matches(text,'[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY n)||i NOT IN ('su','ua','au') AS illegal FROM o),
c AS (SELECT conv_id, coalesce(max(turn)-min(turn)+1-count(DISTINCT turn),0) AS gaps, count(*) FILTER (fault='b') AS blank, count(*) FILTER (fault='d') AS duplicate, count(*) FILTER (fault='t') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS rows FROM f GROUP BY 1),
z AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, {{'c': CAST(0 AS BIGINT), 'a': '', 'x': ''}} AS z0, {{'c': CAST(900000 AS BIGINT), 'a': '', 'x': ''}} AS zs, {{'c': CAST(900000 AS BIGINT), 'a': '', 'x': ''}} AS zu, {{'c': CAST(900000 AS BIGINT), 'a': '', 'x': ''}} AS za FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT s.conv_id, f.n, {_turn("0", "", "")}, {_turn("s", "0", "")}, {_turn("u", "0sa", "user")}, {_turn("a", "u", "assistant")}
FROM (SELECT conv_id, n, z0 AS y0, zs AS ys, {_inserted("u")} AS yu, {_inserted("a")} AS ya FROM z) s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.n=s.n+1),
e AS (SELECT z.conv_id, list_min([z0, {_inserted("a")}]) AS w FROM z LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id WHERE z.n=coalesce(c.rows,0))
SELECT e.conv_id, coalesce(gaps,0) AS gaps, coalesce(blank,0) AS blank, coalesce(duplicate,0) AS duplicate, coalesce(truncated,0) AS truncated, coalesce(illegal,0) AS illegal, w.c AS cost, w.a AS audit, sha256(left(w.x, greatest(length(w.x)-1,0))) AS repaired_sha256
FROM e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id""",
    "digest_op13_base": f"""WITH t AS (SELECT doc_id, coalesce(text,'') AS t FROM documents),
{", ".join(f"m{k} AS (SELECT doc_id, {k} AS k, regexp_extract_all(t, '{p}') AS h, string_split_regex(t, '{p}') AS g FROM t)" for k, p in enumerate(_BASE.values()))},
m AS ({" UNION ALL ".join(f"FROM m{k}" for k in range(4))}),
s AS (SELECT doc_id, k, unnest(list_transform(range(1, len(h)+1), lambda i: {{'v': h[i], 's': CAST(list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[:i-1], lambda x: length(x))), 0) AS BIGINT)}})) AS m FROM m),
d AS (SELECT doc_id, k, m.s AS a, m.s+length(m.v) AS b, m.v AS v, list_transform(list_reverse(regexp_extract_all(m.v, '[0-9]')), lambda x: CAST(x AS BIGINT)) AS d FROM s),
b AS (SELECT doc_id, k, a, b FROM d WHERE CASE k WHEN 0 THEN true WHEN 1 THEN list_max(list_transform(string_split(v,'.'), lambda x: CAST(x AS HUGEINT)))<=255
WHEN 2 THEN len(d) BETWEEN 14 AND 19 AND list_sum(list_transform(d, lambda x, i: CASE WHEN i%2=0 THEN 2*x-CASE WHEN x>4 THEN 9 ELSE 0 END ELSE x END))%10=0 ELSE len(d) BETWEEN 10 AND 15 END)
SELECT t.doc_id, {", ".join(f"count(*) FILTER (k={k}) AS n_{kind}" for k, kind in enumerate(_BASE))}, sha256(coalesce(string_agg(['email','ip','card','phone'][k+1]||':'||a||':'||b, ',' ORDER BY a, k, b), '')) AS base_sha256 FROM t LEFT JOIN b USING (doc_id) GROUP BY 1""",
    "digest_op9_ranks": """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0 AND len(list_filter(embedding, lambda x: x<>0))>0),
s AS (SELECT q.vec_id AS query_id, u.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, u.e) DESC, u.vec_id) AS rank FROM u q JOIN u ON q.vec_id<>u.vec_id WHERE q.vec_id%20=0)
SELECT query_id, rank, vec_id FROM s WHERE rank<=20""",
}
