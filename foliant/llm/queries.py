"""The queries of this subpackage and, where SQL can say it, their DuckDB text."""

from __future__ import annotations

import uuid

import public_tokenizers

from foliant.llm import collocations, lm_scoring, minhash, prefix_trie, quality_classifier, quality_rules, suffix_dedup, token_counts, token_files, window_dedup
from foliant.llm.common import delete_on_exit, shared_dir, table
from foliant.llm.exact_dedup import dedup_report
from foliant.llm.mixing import mix_report
from foliant.llm.packing import pack


def op1_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_repair_tokens(spark, sf_dir):
    path = delete_on_exit(spark, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, path)


def op3_circulant_minhash(spark, sf_dir):
    return minhash.near_copies(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_countmin_windows(spark, sf_dir):
    return window_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op6_mix_curriculum(spark, sf_dir):
    return mix_report(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark, sf_dir):
    return dedup_report(table(spark, sf_dir, "documents"))


def op8_prefix_doubling(spark, sf_dir):
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark, sf_dir):
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"), lm_scoring.good_documents(table(spark, sf_dir, "labels")))


def op10_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_phrase_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_repair_tokens": op2_repair_tokens,
    "op3_circulant_minhash": op3_circulant_minhash,
    "op4_quality_rules": op4_quality_rules,
    "op5_countmin_windows": op5_countmin_windows,
    "op6_mix_curriculum": op6_mix_curriculum,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_prefix_doubling": op8_prefix_doubling,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_token_counts": op13_token_counts,
}

SQL = {
    "op6_mix_curriculum": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS slot FROM s),
w AS (SELECT *, CASE slot WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM r),
l AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS left_total,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS left_weight
  FROM w WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CAST(left_total AS DOUBLE) / CAST(left_weight AS DOUBLE) AS level FROM l),
o AS (
  SELECT *, (SELECT arg_min(level, struct_pack(a := CAST(cap AS DOUBLE) / weight, b := source IS NULL, c := source))
             FROM f WHERE cap >= level * weight) AS open_level FROM f),
t AS (SELECT source, source_size, slot, coalesce(least(CAST(cap AS DOUBLE), open_level * weight), 0) AS target FROM o),
b AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d),
e AS (
  SELECT b.doc_id, b.size, t.source_size, t.target, t.slot, b.before,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target) AS BIGINT) // t.source_size ELSE 0 END AS epochs
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken FROM e),
g AS (SELECT *, CAST(before AS DOUBLE) / target AS met FROM p)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 AND target > 0 THEN
         CASE slot WHEN 0 THEN CASE WHEN met <= 0 THEN 0.0 ELSE 2.0 * met / (1.5 + sqrt(2.25 + -2.0 * met)) END
                   WHEN 1 THEN CASE WHEN met <= 0 THEN 0.0 ELSE 2.0 * met / (1.0 + sqrt(1.0 + 0.0 * met)) END
                   ELSE CASE WHEN met <= 0 THEN 0.0 ELSE 2.0 * met / (0.5 + sqrt(0.25 + 2.0 * met)) END END END AS due
FROM g
""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY sha256(coalesce(text, '')))
""",
    "op11_phrase_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM t),
total AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase FROM w, unnest(range(1, 5)) AS s(size)),
f AS (SELECT lang, phrase, size, count(*) AS f FROM g GROUP BY lang, phrase, size),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS words FROM f WHERE size > 1 AND f >= 30),
cut AS (SELECT lang, phrase, a, k, array_to_string(words[1:k], ' ') AS before, array_to_string(words[k + 1:size], ' ') AS behind FROM c, unnest(range(1, 4)) AS s(k) WHERE k < size),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, min(struct_pack(score := CAST(CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT), k := k, l := x.f, r := y.f)) AS best
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = before JOIN f y ON y.lang = cut.lang AND y.phrase = behind GROUP BY cut.lang, cut.phrase, cut.a),
sub AS (SELECT lang, a, array_to_string(words[i:i + n - 1], ' ') AS phrase FROM c, unnest(range(1, 4)) AS s(i), unnest(range(2, 4)) AS q(n) WHERE n < size AND i + n - 1 <= size),
most AS (SELECT lang, phrase, max(a) AS most FROM sub GROUP BY lang, phrase),
r AS (
  SELECT s.lang, s.phrase, s.a, best.l AS l, best.r AS r, best.score AS score, row_number() OVER (PARTITION BY s.lang ORDER BY best.score DESC, s.a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN most m ON m.lang = s.lang AND m.phrase = s.phrase WHERE most IS NULL OR 100 * most < 80 * s.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN total USING (lang) WHERE rank <= 2000
""",
    "op12_prefix_trie": r"""
WITH own AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
bits AS (SELECT *, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: list_transform(range(8), lambda j: CAST((ascii(ch) >> j) & 1 AS BIGINT)))) AS bits FROM own),
h AS (SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295, bits), lambda crc, bit: xor(crc >> 1, ((crc & 1) + bit) % 2 * 3988292384)), 4294967295) % 9 AS h FROM bits),
rebuilt AS (SELECT h.conv_id, list_concat(coalesce(head.turns[1:h.h], []), h.turns[h.h + 1:len(h.turns)]) AS turns FROM h LEFT JOIN own head ON head.conv_id = h.conv_id - h.conv_id % 5),
members AS (SELECT conv_id, d AS depth, turns[1:d] AS path, len(turns) = d AS ends FROM rebuilt, unnest(range(0, len(turns) + 1)) AS s(d)),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM members GROUP BY path, depth),
kids AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
own_facts AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n_convs - 1) * strlen(n.path[n.depth].text) ELSE 0 END AS saving FROM nodes n LEFT JOIN kids k ON k.path = n.path AND k.depth = n.depth),
sums AS (SELECT path[1:d] AS path, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saving) AS BIGINT) AS saved_tokens FROM own_facts, unnest(range(0, depth + 1)) AS s(d) GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM own_facts n JOIN sums s ON s.path = n.path AND s.depth = n.depth LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
""",
}
