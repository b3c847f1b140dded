"""DuckDB SQL for the registered queries, over the same parquet tables."""

from __future__ import annotations

from strandlake.params import BUCKETS, DEFAULT
from strandlake.sources.dna import LETTERS

P = DEFAULT


def _code(s: str) -> str:
    return f"list_reduce(list_transform(string_split({s}, ''), lambda c: CAST(strpos('ACGT', c) - 1 AS BIGINT)), lambda a, x: a * 4 + x)"


def _rc(s: str) -> str:
    return f"translate(reverse({s}), 'ACGT', 'TGCA')"


def _sampler(n: int, last: str) -> str:
    return f"(list_transform(range(0, {n - 1}), lambda i: CAST(floor(i * ({last} + 1) / {n - 1}.0) AS BIGINT)) || [CAST({last} AS BIGINT)])"


DNA = f"dna AS (SELECT doc_id AS ref_ord, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{'ACGT' * 13}') AS seq FROM documents WHERE text IS NOT NULL)"
BUCKET = f"""{DNA},
b0 AS (SELECT ref_ord, seq, unnest(range(0, CAST(ceil(length(seq) / {P.B}.0) AS BIGINT))) AS idx FROM dna),
b AS (SELECT ref_ord * {BUCKETS} + idx AS bucket_id, ref_ord, idx, idx * {P.B} AS ref_offset, substr(seq, idx * {P.B} + 1, {P.B + P.L}) AS seq FROM b0 WHERE length(seq) - idx * {P.B} > {P.L})"""
QGRAM = f"""{BUCKET},
g0 AS (SELECT bucket_id, seq, unnest(range(0, length(seq) - {P.q - 1})) AS ix FROM b WHERE length(seq) >= {P.q}),
post AS (SELECT DISTINCT bucket_id, substr(seq, ix + 1, {P.q}) AS g FROM g0),
gdf AS (SELECT g, count(*) AS df FROM post GROUP BY g)"""
READ = f"""{DNA},
r0 AS (SELECT *, CASE WHEN ref_ord % 3 = 0 AND length(seq) > {3 * P.L} THEN {3 * P.L} ELSE {P.L} END AS size FROM dna WHERE length(seq) > {P.L + 1}),
r1 AS (SELECT *, (ref_ord * 7919) % (length(seq) - size) AS pos, (ref_ord * 31) % {P.L} AS ix FROM r0),
r2 AS (SELECT ref_ord, size, pos, ix, substr(seq, pos + 1, size) AS piece FROM r1),
r3 AS (SELECT *, substr(piece, 1, ix) || translate(substr(piece, ix + 1, 1), 'ACGT', 'CGTA') || substr(piece, ix + 2) AS wrong FROM r2),
reads AS (SELECT ref_ord AS read_id, 'r' || ref_ord AS name, CASE WHEN ref_ord % 2 = 1 THEN {_rc('wrong')} ELSE wrong END AS seq,
    array_to_string(list_transform(range(0, size), lambda i: chr(CAST(53 + (i * 7 + ref_ord) % 21 AS INT))), '') AS qual, ref_ord, pos, ref_ord % 2 = 1 AS is_rev FROM r3)"""
SEGMENT = f"""{READ},
s0 AS (SELECT read_id, length(seq) AS read_len, seq, qual, unnest(CASE WHEN length(seq) > {2 * P.L} THEN list_distinct({_sampler(P.G, f'(length(seq) - {P.L + 1})')}) ELSE [0] END) AS seg_off FROM reads),
segs AS (SELECT read_id, seg_off, read_len, substr(seq, seg_off + 1, {P.L}) AS seq, substr(qual, seg_off + 1, {P.L}) AS qual FROM s0),
k0 AS (SELECT read_id, seg_off, seq, qual, unnest(range(0, length(seq) - {P.k - 1})) AS pos FROM segs),
k1 AS (SELECT read_id, seg_off, pos, substr(seq, pos + 1, {P.k}) AS km, list_sum(list_transform(range(0, {P.k}), lambda i: ascii(substr(qual, pos + 1 + i, 1)) - 33)) AS quality FROM k0),
good AS (SELECT * FROM k1 WHERE quality >= {P.b * P.k})"""
_SUBS = ", ".join(f"substr(km, {i + 1}, {P.q})" for i in range(P.k - P.q + 1))
CANDIDATE = f"""{QGRAM}, {SEGMENT.removeprefix(DNA + ',')},
n AS (SELECT count(*) AS n FROM b),
common AS (SELECT g FROM gdf, n WHERE n - df < CAST(trunc({P.d} * n) AS BIGINT)),
kd AS (SELECT DISTINCT km FROM good),
ok AS (SELECT DISTINCT km FROM (SELECT km, unnest([{_SUBS}]) AS g FROM kd) WHERE g NOT IN (SELECT g FROM common)),
g2 AS (SELECT *, row_number() OVER (PARTITION BY read_id, seg_off ORDER BY pos) - 1 AS o, count(*) OVER (PARTITION BY read_id, seg_off) AS c FROM good WHERE km IN (SELECT km FROM ok)),
pick AS (SELECT read_id, seg_off, unnest({_sampler(P.S, '(c - 1)')}) AS o, unnest(range(0, {P.S})) AS ord FROM (SELECT DISTINCT read_id, seg_off, c FROM g2) WHERE c >= {0.2 * P.S}),
sd AS (SELECT read_id, seg_off, ord, km FROM pick JOIN g2 USING (read_id, seg_off, o)),
both_ AS (SELECT *, TRUE AS is_original FROM sd UNION ALL SELECT read_id, seg_off, ord, {_rc('km')}, FALSE FROM sd),
kk AS (SELECT DISTINCT km FROM both_),
kg AS (SELECT km, unnest(list_distinct([{_SUBS}])) AS g, len(list_distinct([{_SUBS}])) AS m FROM kk),
hit AS (SELECT km, bucket_id FROM kg JOIN post USING (g) GROUP BY km, bucket_id, m HAVING count(*) = m),
cnt AS (SELECT read_id, seg_off, is_original, bucket_id, {P.S} - count(*) AS misses FROM both_ JOIN hit USING (km) GROUP BY ALL HAVING {P.S} - count(*) < {P.faults}),
top AS (SELECT * FROM cnt QUALIFY rank() OVER (PARTITION BY read_id, seg_off, is_original ORDER BY misses) = 1),
cand AS (SELECT * FROM top QUALIFY count(*) OVER (PARTITION BY read_id, seg_off, is_original) <= {P.C})"""


_NEAR = f"abs(x.pos - one[1].pos) <= {P.indel}"
_SAME = "y.bucket_id = one[1].bucket_id AND y.rev = one[1].rev AND y.off BETWEEN trunc(one[1].off - reach) AND trunc(one[1].off + reach)"
LOCATE = f"""{CANDIDATE},
la AS (SELECT k1.*, count(*) FILTER (quality >= {P.b * P.k}) OVER (PARTITION BY read_id, seg_off) AS ng FROM k1),
lu AS (SELECT *, row_number() OVER (PARTITION BY read_id, seg_off ORDER BY pos) - 1 AS o, count(*) OVER (PARTITION BY read_id, seg_off) AS c FROM la WHERE ng = 0 OR quality >= {P.b * P.k}),
lp AS (SELECT read_id, seg_off, unnest({_sampler(P.P, '(c - 1)')}) AS o, unnest(range(0, {P.P})) AS ord FROM (SELECT DISTINCT read_id, seg_off, c FROM lu)),
ls AS (SELECT lp.read_id, lp.seg_off, ord, pos, km, read_len, length(segs.seq) AS seg_len FROM lp JOIN lu USING (read_id, seg_off, o) JOIN segs USING (read_id, seg_off)),
pr AS (SELECT c.read_id, c.seg_off, c.is_original, c.bucket_id, seg_len, read_len, CASE WHEN c.is_original THEN km ELSE {_rc('km')} END AS km,
    CASE WHEN c.is_original THEN pos ELSE seg_len - {P.k} - pos END AS own, CASE WHEN c.is_original THEN ord ELSE {P.P - 1} - ord END AS turn FROM cand c JOIN ls USING (read_id, seg_off)),
bk AS (SELECT bucket_id, ix, substr(seq, ix + 1, {P.k}) AS km FROM (SELECT bucket_id, seq, unnest(range(0, length(seq) - {P.k - 1})) AS ix FROM b WHERE bucket_id IN (SELECT bucket_id FROM cand))),
ht AS (SELECT read_id, seg_off, is_original, bucket_id, seg_len, read_len, turn, list({{'pos': ix - own, 'votes': 1}} ORDER BY ix) AS h FROM pr JOIN bk USING (bucket_id, km) GROUP BY ALL),
vt AS (SELECT read_id, seg_off, is_original, bucket_id, seg_len, read_len, list_reduce(list(h ORDER BY turn), lambda state, hits: list_reduce([state] || list_transform(hits, lambda h: [h]), lambda st, one:
    CASE WHEN len(list_filter(st, lambda x: {_NEAR})) > 0 THEN list_transform(st, lambda x: {{'pos': x.pos, 'votes': x.votes + CASE WHEN {_NEAR} THEN 1 ELSE 0 END}}) ELSE st || one END)) AS v FROM ht GROUP BY ALL),
bt AS (SELECT *, list_sort(list_transform(v, lambda x: {{'less': -x.votes, 'pos': x.pos}}))[1] AS best FROM vt),
loc AS (SELECT read_id, bucket_id, best.pos - CASE WHEN is_original THEN seg_off ELSE read_len - seg_off - seg_len END AS off, seg_off, -best.less AS votes, is_original FROM bt WHERE -best.less >= {P.least_votes} AND best.pos > 0)"""
MERGE = f"""{LOCATE},
m0 AS (SELECT read_id, length(seq) * {P.n}::DOUBLE AS reach, list([{{'bucket_id': bucket_id, 'off': off, 'rev': CASE WHEN is_original THEN 0 ELSE 1 END, 'votes': votes}}] ORDER BY bucket_id, NOT is_original, CASE WHEN is_original THEN seg_off ELSE -seg_off END, off, votes) AS r
    FROM loc JOIN reads USING (read_id) GROUP BY ALL),
m1 AS (SELECT read_id, list_reduce(r, lambda st, one: CASE WHEN len(list_filter(st, lambda y: {_SAME})) > 0
    THEN list_transform(st, lambda y: {{'bucket_id': y.bucket_id, 'off': y.off, 'rev': y.rev, 'votes': y.votes + CASE WHEN {_SAME} THEN one[1].votes ELSE 0 END}}) ELSE st || one END) AS st FROM m0),
m2 AS (SELECT read_id, unnest(list_filter(st, lambda y: y.votes = list_max(list_transform(st, lambda z: z.votes)))) AS y FROM m1),
best AS (SELECT read_id, y.bucket_id AS bucket_id, y.off AS off, y.rev = 0 AS is_original, y.votes AS votes FROM m2)"""
SAM = f"""{MERGE},
sam AS (SELECT name AS qname, CASE WHEN is_original THEN 0 ELSE 16 END AS flag, bucket_id // {BUCKETS} AS rname, CAST((bucket_id % {BUCKETS}) * {P.B} + off AS BIGINT) AS pos, CAST(least(60, 6 * votes) AS INT) AS mapq, seq, qual FROM best JOIN reads USING (read_id))"""


def _ratio(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} > 0 THEN {a} / {b} END, 6)"


SETS = f"""{DNA},
w AS (SELECT ref_ord, substr(seq, ix + 1, 14) AS km FROM (SELECT ref_ord, seq, unnest(range(0, length(seq) - 13)) AS ix FROM dna WHERE length(seq) >= 14)),
c AS (SELECT DISTINCT ref_ord, least(km, {_rc('km')}) AS km FROM w),
sets AS (SELECT ref_ord, coalesce(list_sort(list(km) FILTER (km IS NOT NULL)), []) AS s FROM dna LEFT JOIN c USING (ref_ord) GROUP BY ref_ord)"""


def _in_sample(code: str) -> str:
    return f"((12345 * {code} + 678) % 116731) % 10000 <= 2500"


_KD = f"list_filter([{_SUBS}], lambda x: {_in_sample(_code('x'))})"
#: Candidates where only a quarter of the q-grams are indexed: a k-mer without any is a hit in every bucket.
SAMPLED = CANDIDATE.replace("common AS (SELECT g FROM gdf, n WHERE", f"sdf AS (SELECT g, df FROM gdf WHERE {_in_sample(_code('g'))}),\ncommon AS (SELECT g FROM sdf, n WHERE")
SAMPLED = SAMPLED.replace(f"unnest([{_SUBS}]) AS g FROM kd", f"unnest({_KD}) AS g FROM kd")
SAMPLED = SAMPLED.replace(f"unnest(list_distinct([{_SUBS}])) AS g, len(list_distinct([{_SUBS}])) AS m FROM kk", f"unnest(list_distinct({_KD})) AS g, len(list_distinct({_KD})) AS m FROM kk")
SAMPLED = SAMPLED.replace(
    "cnt AS (",
    f"""wild AS (SELECT read_id, seg_off, is_original, count(*) AS w FROM both_ WHERE km NOT IN (SELECT km FROM kg) GROUP BY ALL),
hits AS (SELECT read_id, seg_off, is_original, bucket_id, count(*) AS h FROM both_ JOIN hit USING (km) GROUP BY ALL
    UNION ALL SELECT read_id, seg_off, is_original, bucket_id, 0 FROM wild, b WHERE {P.S} - w < {P.faults}),
cnt AS (SELECT read_id, seg_off, is_original, bucket_id, {P.S} - max(h) - coalesce(max(w), 0) AS misses FROM hits LEFT JOIN wild USING (read_id, seg_off, is_original) GROUP BY ALL HAVING {P.S} - max(h) - coalesce(max(w), 0) < {P.faults}),
unused AS (""",
)
#: Gapped shape of the quality query, as in the registry.
SHAPE = "110110111011"
_ONES = [i for i, c in enumerate(SHAPE) if c == "1"]
#: Every contig's score for every read, k-mers that a contig lacks included.
SCORES = f"""{READ}, k AS (SELECT ref_ord, substr(seq, ix + 1, {P.q}) AS km, count(*) AS n FROM (SELECT ref_ord, seq, unnest(range(0, length(seq) - {P.q - 1})) AS ix FROM dna WHERE length(seq) >= {P.q}) GROUP BY ALL),
t AS (SELECT ref_ord AS c, sum(n) + 0.001 * {4**P.q} AS total FROM k GROUP BY ref_ord),
m AS (SELECT ref_ord AS c, km, ln((n + 0.001) / total) AS logp FROM k JOIN t ON k.ref_ord = t.c),
rk AS (SELECT read_id, substr(s, ix + 1, {P.q}) AS km, count(*) AS n FROM (SELECT read_id, CASE WHEN is_rev THEN {_rc('seq')} ELSE seq END AS s, unnest(range(0, length(seq) - {P.q - 1})) AS ix FROM reads) GROUP BY ALL),
z AS (SELECT read_id, sum(n) AS size FROM rk GROUP BY read_id),
g AS (SELECT read_id, c, sum(rk.n * (logp - ln(0.001 / total))) AS gain FROM rk JOIN m USING (km) JOIN t USING (c) GROUP BY ALL),
sc AS (SELECT z.read_id, t.c, round(coalesce(gain, 0) + size * ln(0.001 / total), 6) AS score FROM z CROSS JOIN t LEFT JOIN g USING (read_id, c))"""
MARGINS = f"""{SCORES},
o AS (SELECT read_id, max({{'score': score, 'neg': -c}}) FILTER (c <> ref_ord) AS o, max(score) FILTER (c = ref_ord) AS hit FROM sc JOIN reads USING (read_id) GROUP BY read_id),
mg AS (SELECT read_id, hit, o.score AS other, hit IS NOT NULL AND (o IS NULL OR hit > o.score OR hit = o.score AND ref_ord < -o.neg) AS correct FROM o JOIN reads USING (read_id))"""


def _log(x: str) -> str:
    return f"ln({x})"


def sql() -> dict[str, str]:
    share = lambda k, table: f"k AS (SELECT ref_ord, substr(seq, ix + 1, {k}) AS km, count(*) AS n FROM (SELECT ref_ord, seq, unnest(range(0, length(seq) - {k - 1})) AS ix FROM {table} WHERE length(seq) >= {k}) GROUP BY ALL)"
    return {
        "contigs": f"WITH {DNA} SELECT ref_ord, length(seq) AS n_bases, md5(seq) AS digest FROM dna",
        "bucketize": f"WITH {BUCKET} SELECT bucket_id, ref_ord, idx, ref_offset, length(seq) AS n_bases, md5(seq) AS digest FROM b",
        "bucket_ordinals": f"WITH {BUCKET} SELECT bucket_id, row_number() OVER (ORDER BY ref_ord, idx) - 1 AS ordinal FROM b",
        "genome_stats": f"WITH {DNA} SELECT count(*) AS n_refs, CAST(sum(length(seq)) AS BIGINT) AS n_bases, CAST(sum(ceil(length(seq) / {P.B}.0)) AS BIGINT) AS n_slices, max(length(seq)) AS longest FROM dna",
        "qgram_df": f"WITH {QGRAM} SELECT {_code('g')} AS qgram, df FROM gdf",
        "bucket_postings": f"WITH {QGRAM}, c AS (SELECT g, {_code('g')} AS code FROM gdf) SELECT bucket_id, count(*) AS n_distinct, min(code) AS least, max(code) AS most, md5(string_agg(CAST(code AS VARCHAR), ',' ORDER BY code)) AS digest FROM post JOIN c USING (g) GROUP BY bucket_id",
        "frac_min_hash": f"WITH {QGRAM}, c AS (SELECT {_code('g')} AS qgram FROM gdf) SELECT qgram, ((12345 * qgram + 678) % 116731) % 10000 AS hash, ((12345 * qgram + 678) % 116731) % 10000 <= 2500 AS kept FROM c",
        "distinguishability": f"WITH {QGRAM}, n AS (SELECT count(*) AS n FROM b) SELECT count(*) AS n_qgrams, count(*) FILTER (n - df >= CAST(trunc({P.d} * n) AS BIGINT)) AS n_rare, count(*) FILTER (n - df > CAST(trunc({P.d} * n) AS BIGINT)) AS n_rare_strict, max(df) AS most FROM gdf, n",
        "simulated_reads": f"WITH {READ} SELECT * FROM reads",
        "segments": f"WITH {SEGMENT} SELECT read_id, CAST(seg_off AS INT) AS seg_off, CAST(length(seq) AS INT) AS seg_len, CAST(read_len AS INT) AS read_len, seq FROM segs",
        "good_kmers": f"WITH {SEGMENT}, f AS (SELECT read_id, seg_off, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS places, string_agg(CAST({_code('km')} AS VARCHAR), ',' ORDER BY pos) AS kmers FROM good GROUP BY ALL) SELECT segs.read_id, CAST(segs.seg_off AS INT) AS seg_off, coalesce(n, 0) AS n_good, coalesce(places, '') AS places, coalesce(kmers, '') AS kmers FROM segs LEFT JOIN f USING (read_id, seg_off)",
        "locating_seeds": f"""WITH {SEGMENT}, a AS (SELECT k1.*, count(*) FILTER (quality >= {P.b * P.k}) OVER (PARTITION BY read_id, seg_off) AS ng FROM k1),
            u AS (SELECT *, row_number() OVER (PARTITION BY read_id, seg_off ORDER BY pos) - 1 AS o, count(*) OVER (PARTITION BY read_id, seg_off) AS c FROM a WHERE ng = 0 OR quality >= {P.b * P.k}),
            p AS (SELECT read_id, seg_off, unnest({_sampler(P.P, '(c - 1)')}) AS o, unnest(range(0, {P.P})) AS ord FROM (SELECT DISTINCT read_id, seg_off, c FROM u))
            SELECT read_id, CAST(seg_off AS INT) AS seg_off, CAST(ord AS INT) AS ord, CAST(pos AS INT) AS pos, {_code('km')} AS kmer FROM p JOIN u USING (read_id, seg_off, o)""",
        "reverse_complement": f"""WITH {READ}, f AS (SELECT read_id, seq, substr(seq, 1, {P.k}) AS km FROM reads)
            SELECT read_id, {_code('km')} AS code, {_code(_rc('km'))} AS rc_code, least({_code('km')}, {_code(_rc('km'))}) AS canonical, km AS decoded, {_rc('seq')} AS rc_seq,
            '[' || {" || ',' || ".join(_code(f'substr(km, {i + 1}, {P.q})') for i in reversed(range(P.k - P.q + 1)))} || ']' AS subcodes,
            md5(array_to_string(list_transform(range(0, length(seq) - {P.k - 1}), lambda i: least({_code(f'substr(seq, i + 1, {P.k})')}, {_code(_rc(f'substr(seq, i + 1, {P.k})'))})), ',')) AS canonical_digest,
            md5(array_to_string(list_transform(range(0, length(seq) - {P.k - 1}), lambda i: {_code(f"substr({_rc('seq')}, i + 1, {P.k})")}), ',')) AS rc_digest FROM f""",
        "candidate_buckets": f"WITH {CANDIDATE} SELECT read_id, CAST(seg_off AS INT) AS seg_off, is_original, bucket_id, misses FROM cand",
        "candidate_levels": f"WITH {CANDIDATE}, l AS (SELECT read_id, seg_off, is_original, misses, count(*) AS n FROM cnt GROUP BY ALL) SELECT read_id, CAST(seg_off AS INT) AS seg_off, is_original, misses, n, CAST(sum(n) OVER (PARTITION BY read_id, seg_off, is_original ORDER BY misses) AS BIGINT) AS n_upto FROM l",
        "candidate_stats": f"WITH {CANDIDATE}, t AS (SELECT count(DISTINCT read_id) AS m, count(*) FILTER (is_original) AS f, count(*) FILTER (NOT is_original) AS r FROM cand) SELECT (SELECT count(*) FROM reads) AS n_reads, m AS mapped, round(f / m, 6) AS fwd_per_read, round(r / m, 6) AS rev_per_read FROM t",
        "candidate_histogram": f"WITH {CANDIDATE}, c AS (SELECT read_id, count(*) AS n FROM cand GROUP BY read_id) SELECT coalesce(n, 0) AS n_candidates, count(*) AS n_reads FROM reads LEFT JOIN c USING (read_id) GROUP BY 1",
        "mapping_recall": f"WITH {CANDIDATE} SELECT (SELECT count(*) FROM reads) AS n_reads, count(DISTINCT c.read_id) AS n_right FROM cand c JOIN reads r ON c.read_id = r.read_id AND c.is_original = NOT r.is_rev AND c.bucket_id = r.ref_ord * {BUCKETS} + CAST(floor(r.pos / {P.B}.0) AS BIGINT)",
        "unmapped_reads": f"WITH {CANDIDATE} SELECT read_id, name FROM reads WHERE read_id NOT IN (SELECT read_id FROM cand)",
        "locations": f"WITH {LOCATE} SELECT read_id, bucket_id, CAST(off AS INT) AS \"offset\", CAST(seg_off AS INT) AS seg_off, CAST(votes AS INT) AS votes, is_original FROM loc",
        "best_locations": f"WITH {MERGE} SELECT read_id, bucket_id, CAST(off AS INT) AS \"offset\", is_original, CAST(votes AS INT) AS votes FROM best",
        "sam": f"WITH {SAM} SELECT * FROM sam",
        "sam_report": f"""WITH {SAM}, per AS (SELECT r.name, count(s.qname) AS n_rows, count(*) FILTER (s.flag = CASE WHEN is_rev THEN 16 ELSE 0 END AND s.rname = ref_ord AND abs(s.pos - r.pos) <= 5) AS n_right FROM reads r LEFT JOIN sam s ON s.qname = r.name GROUP BY r.name),
            t AS (SELECT count(*) AS n_reads, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) FILTER (n_rows = 1) AS n_mapped, count(*) FILTER (n_rows = 1 AND n_right > 0) AS n_unique_right, CAST(sum(n_right) AS BIGINT) AS n_right FROM per)
            SELECT n_reads, n_rows, {_ratio('n_mapped', 'n_reads')} AS mapped, {_ratio('n_unique_right', 'n_reads')} AS sensitivity, CAST(NULL AS DOUBLE) AS false_positive, {_ratio('n_rows', 'n_mapped')} AS locations_per_read, {_ratio('n_right', 'n_rows')} AS precision FROM t""",
        "locator_accuracy": f"""WITH {SAM}, near AS (SELECT r.name, min(abs(s.pos - r.pos)) AS off FROM sam s JOIN reads r ON s.qname = r.name AND s.rname = r.ref_ord AND (s.flag = 16) = r.is_rev GROUP BY r.name)
            SELECT (SELECT count(*) FROM reads) AS n_reads, (SELECT count(DISTINCT qname) FROM sam) AS n_located, count(*) AS n_right_contig, count(*) FILTER (off = 0) AS n_exact, count(*) FILTER (off <= 5) AS n_almost, round(avg(off), 6) AS mean_offset FROM near""",
        "bucket_accuracy": f"""WITH {MERGE}, per AS (SELECT read_id, count(*) AS n FROM best GROUP BY read_id), tr AS (SELECT read_id, ref_ord * {BUCKETS} + pos // {P.B} AS tb, pos % {P.B} AS toff FROM reads),
            h AS (SELECT abs(off - toff) AS e, n FROM best JOIN tr USING (read_id) JOIN per USING (read_id) WHERE bucket_id = tb), a AS (SELECT coalesce(n, 0) AS n FROM tr LEFT JOIN per USING (read_id))
            SELECT a.*, h.* FROM (SELECT count(*) AS n_reads, round(avg(n), 6) AS buckets_per_read, count(*) FILTER (n = 0) AS n_none, count(*) FILTER (n = 1) AS n_unique, count(*) FILTER (n BETWEEN 1 AND 5) AS n_upto_5, count(*) FILTER (n BETWEEN 1 AND 10) AS n_upto_10 FROM a) a,
            (SELECT count(*) AS n_right_bucket, round(avg(e), 6) AS mean_offset_error, count(*) FILTER (e <= {P.indel}) AS n_almost, count(*) FILTER (e <= {P.indel} AND n = 1) AS n_unique_right FROM h) h""",
        "sampled_candidates": f"WITH {SAMPLED} SELECT read_id, CAST(seg_off AS INT) AS seg_off, is_original, bucket_id, misses FROM cand",
        "streamed_candidates": f"WITH {CANDIDATE} SELECT read_id, CAST(seg_off AS INT) AS seg_off, is_original, bucket_id, misses FROM cand",
        "sam_report_by_file": f"""WITH {SAM}, every AS (SELECT name AS qname, CASE WHEN is_original THEN 0 ELSE 16 END AS flag, bucket_id // {BUCKETS} AS rname, (bucket_id % {BUCKETS}) * {P.B} + off AS pos FROM loc JOIN reads USING (read_id)),
            both_files AS (SELECT 'best' AS mapper, qname, flag, rname, pos FROM sam UNION ALL SELECT 'every', * FROM every),
            per AS (SELECT f.mapper, r.name, count(*) AS n_rows, count(*) FILTER (f.flag = CASE WHEN is_rev THEN 16 ELSE 0 END AND f.rname = ref_ord AND abs(f.pos - r.pos) <= 5) AS n_right FROM both_files f JOIN reads r ON f.qname = r.name GROUP BY ALL),
            t AS (SELECT mapper, (SELECT count(*) FROM reads) AS n_reads, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) FILTER (n_rows = 1) AS n_mapped, count(*) FILTER (n_rows = 1 AND n_right > 0) AS n_unique_right, CAST(sum(n_right) AS BIGINT) AS n_right FROM per GROUP BY mapper)
            SELECT mapper, n_reads, n_rows, {_ratio('n_mapped', 'n_reads')} AS mapped, {_ratio('n_unique_right', 'n_reads')} AS sensitivity, CAST(NULL AS DOUBLE) AS false_positive, {_ratio('n_rows', 'n_mapped')} AS locations_per_read, {_ratio('n_right', 'n_rows')} AS precision FROM t""",
        "unique_reads": f"""WITH {MERGE}, a AS (SELECT read_id, count(*) = 1 AS a FROM best GROUP BY read_id), c AS (SELECT read_id, count(DISTINCT bucket_id) = 1 AS c FROM cand GROUP BY read_id)
            SELECT coalesce(a, FALSE) AS answer_unique, coalesce(c, FALSE) AS test_unique, count(*) AS n_reads FROM a FULL JOIN c USING (read_id) GROUP BY ALL""",
        "gapped_quality": f"""WITH {SEGMENT}, w AS (SELECT read_id, seg_off, CASE WHEN length(seq) >= {P.k} THEN list_transform(range(0, length(seq) - {P.k - 1}), lambda i: {' + '.join(f'ascii(substr(qual, i + {o + 1}, 1)) - 33' for o in _ONES)}) ELSE [] END AS s FROM segs)
            SELECT read_id, CAST(seg_off AS INT) AS seg_off, '[' || array_to_string(s, ',') || ']' AS sums, '[' || coalesce(array_to_string(list_filter(range(0, len(s)), lambda i: s[i + 1] >= {P.b * len(_ONES)}), ','), '') || ']' AS good FROM w""",
        "kmer_slots": f"""WITH dna AS (SELECT doc_id AS ref_ord, translate(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'), '{LETTERS}0123456789', '{'ACGT' * 13}NNNNNNNNNN') AS seq FROM documents WHERE text IS NOT NULL), {share(5, 'dna')},
            every AS (SELECT list_reduce(list_transform(range(0, 5), lambda i: substr('ACGT', 1 + (x >> (8 - 2 * i)) % 4, 1)), lambda a, c: a || c) AS km FROM range(0, 1024) r(x)), own AS (SELECT km, row_number() OVER (ORDER BY km) - 1 AS slot FROM every WHERE km <= {_rc('km')}),
            j AS (SELECT ref_ord, coalesce(slot, 512) AS slot, n FROM k LEFT JOIN own ON own.km = least(k.km, {_rc('k.km')}) AND NOT contains(k.km, 'N'))
            SELECT ref_ord, slot, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / sum(sum(n)) OVER (PARTITION BY ref_ord), 9) AS share FROM j GROUP BY ref_ord, slot""",
        "kmer_dictionary": f"""WITH {BUCKET}, g AS (SELECT bucket_id, ix, substr(seq, ix + 1, {P.q}) AS km FROM (SELECT bucket_id, seq, unnest(range(0, length(seq) - {P.q - 1})) AS ix FROM b)), c AS (SELECT least(km, {_rc('km')}) AS km, min({{'b': bucket_id, 'i': ix}}) AS f FROM g GROUP BY ALL)
            SELECT {_code('km')} AS kmer, row_number() OVER (ORDER BY f.b, f.i) - 1 AS slot, f.b AS bucket_id, CAST(f.i AS INT) AS \"at\" FROM c""",
        "bucket_frequency_model": f"WITH {BUCKET}, {share(5, 'b').replace('ref_ord', 'bucket_id')} SELECT bucket_id, {_code('km')} AS kmer, round({_log('(n + 0.001) / (sum(n) OVER (PARTITION BY bucket_id) + 0.001 * 1024)')}, 6) AS logp FROM k",
        "bucket_markov_model": f"WITH {BUCKET}, {share(4, 'b').replace('ref_ord', 'bucket_id')} SELECT bucket_id, {_code('substr(km, 1, 3)')} AS prefix, {_code('substr(km, 4, 1)')} AS base, round({_log('(n + 0.001) / (sum(n) OVER (PARTITION BY bucket_id, substr(km, 1, 3)) + 0.004)')}, 6) AS logp FROM k",
        "bucket_jaccard": f"""WITH {BUCKET}, w AS (SELECT DISTINCT bucket_id, least(km, {_rc('km')}) AS km FROM (SELECT bucket_id, substr(seq, ix + 1, 14) AS km FROM (SELECT bucket_id, seq, unnest(range(0, length(seq) - 13)) AS ix FROM b))),
            sets AS (SELECT bucket_id, list_sort(list(km)) AS s FROM w GROUP BY bucket_id), d AS (SELECT min(bucket_id) AS r, s FROM sets GROUP BY s), f AS (SELECT r, len(s) AS n, unnest(s) AS km FROM d),
            p AS (SELECT x.r AS a, y.r AS b, x.n + y.n AS n, count(*) AS shared FROM f x JOIN f y ON x.km = y.km AND x.r < y.r GROUP BY ALL)
            SELECT a, b, shared, round(shared / (n - shared), 9) AS jaccard FROM p WHERE shared / (n - shared) >= 0.5""",
        "classified_reads": f"WITH {SCORES}, x AS (SELECT read_id, max({{'score': score, 'neg': -c}}) AS o FROM sc GROUP BY read_id) SELECT read_id, -o.neg AS ref_ord, o.score AS score FROM x",
        "classification_margins": f"WITH {MARGINS} SELECT * FROM mg",
        "classification_harness": f"WITH {MARGINS} SELECT count(*) AS n_queries, count(*) FILTER (correct) AS n_right, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS right_share, round(avg(hit), 4) AS mean_hit, round(avg(other), 4) AS mean_other, round(avg(hit - other), 4) AS mean_margin FROM mg",
        "frequency_model_spread": f"""WITH {DNA}, {share(4, 'dna')}, v AS (SELECT ref_ord, km, CAST(n AS DOUBLE) AS weight FROM k UNION ALL
            SELECT ref_ord, substr(km, 1, i) || substr('ACGT', (strpos('ACGT', substr(km, i + 1, 1)) - 1 + s) % 4 + 1, 1) || substr(km, i + 2), 0.01::DOUBLE * n FROM k, range(0, 4) p(i), range(1, 4) q(s)), w AS (SELECT ref_ord, km, sum(weight) AS weight FROM v GROUP BY ALL)
            SELECT ref_ord, {_code('km')} AS kmer, round(ln((weight + 0.001) / (sum(weight) OVER (PARTITION BY ref_ord) + 0.001 * 256)), 6) AS logp FROM w""",
        "fasta_round_trip": f"WITH {DNA} SELECT 'c' || ref_ord AS ref_id, length(seq) AS n_bases, md5(seq) AS digest FROM dna",
        "fastq_round_trip": f"WITH {READ} SELECT name, seq, qual FROM reads",
        "threshold_logs": f"WITH {QGRAM}, n AS (SELECT count(*) AS n FROM b) SELECT i / 10.0::DOUBLE AS threshold, count(*) FILTER (n - df >= CAST(trunc(i / 10.0::DOUBLE * n) AS BIGINT)) AS n_qgrams FROM gdf, n, range(0, 10) r(i) GROUP BY i",
        "fastq_profile": f"""WITH {READ}, q AS (SELECT length(seq) AS n, list_transform(range(0, length(qual)), lambda i: ascii(substr(qual, i + 1, 1)) - 33) AS q FROM reads),
            p AS (SELECT n, list_sum(q) AS t, len(list_filter(q, lambda x: x < {P.b})) AS low, list_sum(list_transform(q, lambda x: pow(10.0, x / -10.0))) AS err FROM q)
            SELECT count(*) AS n_reads, CAST(sum(n) AS BIGINT) AS n_bases, max(n) AS max_length, round(min(t / n), 6) AS min_mean_quality, round(sum(t) / sum(n), 6) AS mean_quality, max(low) AS max_low_bases, round(avg(low), 6) AS avg_low_bases, round(sum(err) / sum(n), 9) AS error_rate FROM p""",
        "kmer_profile": f"""WITH {DNA}, {share(4, 'dna')}, c AS (SELECT ref_ord, least({_code('km')}, {_code(_rc('km'))}) AS kmer, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY ALL)
            SELECT ref_ord, kmer, n, round(n / sum(n) OVER (PARTITION BY ref_ord), 9) AS share FROM c""",
        "gapped_kmers": f"WITH {BUCKET}, g AS (SELECT bucket_id, seq, unnest(range(0, length(seq) - 5)) AS ix FROM b WHERE length(seq) >= 6) SELECT bucket_id, substr(seq, ix + 1, 1) || substr(seq, ix + 3, 2) || substr(seq, ix + 6, 1) AS gapped, count(*) AS n FROM g GROUP BY ALL",
        "bucket_profile": f"""WITH {BUCKET}, k AS (SELECT bucket_id, substr(seq, ix + 1, 3) AS km, count(*) AS n FROM (SELECT bucket_id, seq, unnest(range(0, length(seq) - 2)) AS ix FROM b) GROUP BY ALL),
            m AS (SELECT km, least({_code('km')}, {_code(_rc('km'))}) AS kmer FROM (SELECT DISTINCT km FROM k)), c AS (SELECT bucket_id, kmer, CAST(sum(n) AS BIGINT) AS n FROM k JOIN m USING (km) GROUP BY ALL)
            SELECT bucket_id, kmer, n, round(n / sum(n) OVER (PARTITION BY bucket_id), 9) AS share FROM c""",
        "contig_sets": f"WITH {SETS} SELECT ref_ord, min(ref_ord) OVER (PARTITION BY s) AS representative FROM sets",
        "contig_jaccard": f"""WITH {SETS}, d AS (SELECT min(ref_ord) AS r, s FROM sets GROUP BY s), f AS (SELECT r, len(s) AS n, unnest(s) AS km FROM d WHERE len(s) > 0),
            p AS (SELECT x.r AS a, y.r AS b, x.n + y.n AS n, count(*) AS shared FROM f x JOIN f y ON x.km = y.km AND x.r < y.r GROUP BY ALL)
            SELECT a, b, shared, round(shared / (n - shared), 9) AS jaccard FROM p WHERE shared / (n - shared) >= 0.5""",
        "frequency_model": f"WITH {DNA}, {share(5, 'dna')} SELECT ref_ord, {_code('km')} AS kmer, round({_log('(n + 0.001) / (sum(n) OVER (PARTITION BY ref_ord) + 0.001 * 1024)')}, 6) AS logp FROM k",
        "markov_model": f"WITH {DNA}, {share(5, 'dna')} SELECT ref_ord, {_code('substr(km, 1, 4)')} AS prefix, {_code('substr(km, 5, 1)')} AS base, round({_log('(n + 0.001) / (sum(n) OVER (PARTITION BY ref_ord, substr(km, 1, 4)) + 0.004)')}, 6) AS logp FROM k",
    }
