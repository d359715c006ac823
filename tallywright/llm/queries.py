"""The registered query of each operator, over the whole of its given table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import ann, bpe, centroids, chat, jaccard, langid, minhash, mixing, pfor, quality, repair, sharding, urls
from tallywright.llm.common import new_table_path, read, word_count


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document; digests of the ids and of the decoded text."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(documents, "text", ranks, public_tokenizers.PATTERN).select("doc_id", "ids")
    return bpe.decode(encoded, "ids", ranks).select("doc_id", *bpe.digests(encoded))


def op2_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into eight shards of near equal bytes."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    sized = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = sharding.shard_by_bytes(sized, ["doc_id", "text_crc32", "size"], "size", 8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def op3_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles have a similarity of 0.75 or more."""
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op4_pfor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of every document, and describes what is read back."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        definition = file.read()
    path = new_table_path(spark, "token_ids")
    pfor.write_ids(read(spark, sf_dir, "documents"), path, definition, end_id=1)
    n_tokens = (F.octet_length("coded") / 4).cast("bigint").alias("n_tokens")
    return pfor.read_coded(spark, path).select("doc_id", "start", n_tokens, F.crc32("coded").alias("ids_crc32"))


ALLOW = ("org/", "com/fr/")
BLOCK = ("example.org/es/", "example.org/en/1", "com/de/")


def op5_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL by the longest of five rules."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, "url", ALLOW, BLOCK).select("page_id", "host", "path", "rule", "verdict")


def op6_mixture_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    documents = read(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out")
    )
    model = langid.fit(documents.where("not held_out and doc_id is not null"), "text", "lang", key=["doc_id"])
    predicted = langid.predict(documents.select("doc_id", "held_out", "text"), "text", model)
    return predicted.select("doc_id", "held_out", "lang_pred", "score")


def op7_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 1, 2, 3 of their sources in order."""
    documents = read(spark, sf_dir, "documents").select(
        "doc_id", "source", word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("text_hash")
    )
    mixed = mixing.mix(documents, "source", F.col("words"), ["doc_id", "text_hash"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


EXTRA_CONVERSATION = [
    (-7, 0, "user", "</s>[INST] ok [/INST]"),
    (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
]


def op8_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all conversations and one that quotes control strings, and describes what is read back."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_CONVERSATION, "conv_id bigint, turn bigint, role string, text string")
    path = new_table_path(spark, "chat_packs")
    chat.write_packs(turns.unionByName(extra), path)
    return chat.read_back(spark.read.parquet(path))


def op9_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures and the verdict of the rule cascade for every document."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(documents, "text").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found to every hundredth vector among all others."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(ann.build(vectors), vectors.where("vec_id % 100 = 0"), k=10)


def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of three-word shingles have a similarity of 0.85 or more."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op12_audit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages all conversations and describes their cheapest repair."""
    damaged = repair.damage(read(spark, sf_dir, "conversations"))
    return repair.audits(repair.repair(damaged, dropped=F.col("dropped")))


def op13_lookup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after ten rounds of centroids in whole numbers."""
    return centroids.described(spark, centroids.cluster(read(spark, sf_dir, "embeddings")))


QUERIES = {
    run.__name__: run
    for run in (
        op1_byte_bpe,
        op2_slot_sharding,
        op3_signature_join,
        op4_pfor_ids,
        op5_url_cascade,
        op6_mixture_langid,
        op7_entropy_mix,
        op8_chat_tree,
        op9_rule_cascade,
        op10_dimension_scan,
        op11_superminhash,
        op12_audit_repair,
        op13_lookup_clusters,
    )
}

_WORDS = r"[x FOR x IN regexp_split_to_array({}, '[\x20\x09-\x0D]+') IF x <> '']"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LISTED = ", ".join(
    [f"('{rule}', 'allow')" for rule in ALLOW] + [f"('{rule}', 'block')" for rule in BLOCK]
)
_CONTROL = "|".join(control.replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for control in chat.CONTROL)


def _written_chars(text: str) -> str:
    """Length of a text once its control strings are broken up: two more for each, one more for each escape."""
    return (
        f"(length({text}) + 2 * len(regexp_extract_all({text}, '{_CONTROL}'))"
        f" + length({text}) - length(replace({text}, '{chat.ESCAPE}', '')))"
    )


def _sql_near_duplicates(words: int, percent: int, more: str = "") -> str:
    return f"""
        WITH RECURSIVE split AS (
            SELECT doc_id, {_WORDS.format(_LOWER)} AS words FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {words} THEN [words]
                ELSE [list_slice(words, i, i + {words - 1}) FOR i IN generate_series(1, len(words) - {words - 1})] END) AS shingle
            FROM split
        ), sizes AS (
            SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS n
            FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * shared.n >= {percent} * (x.n + y.n - shared.n)
        ), either_way AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reached AS (
            SELECT doc_id, doc_id AS seen FROM documents
            UNION
            SELECT reached.doc_id, l.b FROM reached JOIN either_way l ON l.a = reached.seen
        )
        SELECT d.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, MIN(reached.seen) AS component_id{more}
        FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reached USING (doc_id) GROUP BY d.doc_id"""


def _sql_clusters(rounds: int = centroids.ROUNDS) -> str:
    """The rounds one after the other, over one row per vector and dimension."""

    def nearest(at: int) -> str:
        return f"""near_{at} AS MATERIALIZED (
            SELECT rid, c, distance FROM (
                SELECT rid, c, CAST(SUM((v - x) * (v - x)) AS BIGINT) AS distance
                FROM long JOIN c_{at} USING (d) GROUP BY rid, c
            ) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, c) = 1
        )"""

    steps = [
        f"""{nearest(at)}, c_{at + 1} AS MATERIALIZED (
            SELECT c, d, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (
                SELECT c, d, SUM(v) AS s, COUNT(*) AS n FROM long JOIN near_{at} USING (rid) GROUP BY c, d
            ) UNION ALL SELECT c, d, x FROM c_{at} WHERE c NOT IN (SELECT c FROM near_{at})
        )"""
        for at in range(rounds)
    ]
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
            WHERE len(embedding) = {centroids.DIMS}
              AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {centroids.DIMS}
        ), long AS MATERIALIZED (
            SELECT rid, d, CAST(floor({centroids.SCALE} * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS v
            FROM kept, generate_series(1, {centroids.DIMS}) AS dims(d)
        ), c_0 AS MATERIALIZED (
            SELECT place - 1 AS c, d, v AS x FROM long JOIN (
                SELECT rid, row_number() OVER (ORDER BY sha256('{centroids.SEED}' || vec_id)) AS place FROM kept
            ) USING (rid) WHERE place <= {centroids.CLUSTERS}
        ), {", ".join(steps)}, {nearest(rounds)}, digests AS (
            SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c_{rounds} GROUP BY c
        )
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance,
               CAST(SUM(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(SUM(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM near_{rounds} JOIN kept USING (rid) JOIN digests USING (c)"""


def _sql_repair() -> str:
    """Row after row, the cheapest edits for each of four places, as whole strings with the repaired lines."""

    def after(source: str, cost: str, letter: str, line: str = "''", when: str = "true") -> str:
        changed = f"{{'c': {source}.c + {cost}, 'a': {source}.a || '{letter}', 'o': {source}.o || {line}}}"
        return f"CASE WHEN {source} IS NOT NULL AND {when} THEN {changed} END"

    def turn(source: str, role: str) -> list[str]:
        kept = after(source, "truncated", "K", "chr(10) || role || ':' || text", f"stays AND initial = '{role[0]}'")
        given = f"chr(10) || '{role}:' || text"
        return [kept, after(source, "truncated + 2", "R", given, f"stays AND initial <> '{role[0]}'")]

    def inserted(source: str, role: str) -> str:
        return after(source, "2", "I", f"chr(10) || '{role}:'")

    deleted = [after(f"s{at}", "3", "D") for at in range(4)]
    to_user = [deleted[2]] + [way for at in (0, 1, 3) for way in turn(f"s{at}", "user")]
    to_assistant = [deleted[3], *turn("s2", "assistant")]
    to_system = [deleted[1], after("s0", "truncated", "K", "chr(10) || role || ':' || text", "stays AND initial = 's'")]
    empty_user = ", ".join(inserted(f"r{at}", "user") for at in (0, 1, 3))
    return rf"""
        WITH RECURSIVE bytes(i) AS (
            SELECT CAST(0 AS BIGINT) UNION ALL SELECT i + 1 FROM bytes WHERE i < 255
        ), crc_table AS (
            SELECT list(v ORDER BY i) AS tab FROM (
                SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda x, y:
                       CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM bytes
            )
        ), keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
            FROM conversations
        ), hit AS (
            SELECT keyed.*, xor(list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(key, '')]),
                   lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS hit
            FROM keyed, crc_table
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
                   CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS again
            FROM hit WHERE hit <> 0
        ), numbered AS (
            SELECT *, left(role, 1) AS initial, row_number() OVER in_order AS place, lag(left(role, 1)) OVER in_order AS before,
                   NOT regexp_matches(text, '[^ 	-
]') AS blank,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 AS repeated,
                   NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut
            FROM damaged WINDOW in_order AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)
        ), judged AS (
            SELECT *, NOT blank AND repeated AS duplicate, NOT (blank OR repeated) AS stays,
                   CASE WHEN NOT (blank OR repeated) AND cut THEN 1 ELSE 0 END AS truncated FROM numbered
        ), beginning AS (
            SELECT {{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}} AS s0,
                   {{'c': CAST(2 AS BIGINT), 'a': 'I', 'o': chr(10) || 'user:'}} AS s2,
                   {{'c': CAST(4 AS BIGINT), 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3
        ), repairs AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS place, s0, CASE WHEN false THEN s0 END AS s1, s2, s3
            FROM (SELECT DISTINCT conv_id FROM conversations), beginning
            UNION ALL
            SELECT conv_id, place, r0 AS s0, r1 AS s1, n2 AS s2, list_min([r3, {inserted('n2', 'assistant')}]) AS s3 FROM (
                SELECT *, list_min([r2, {empty_user}]) AS n2 FROM (
                    SELECT repairs.conv_id, judged.place, {deleted[0]} AS r0, list_min([{", ".join(to_system)}]) AS r1,
                           list_min([{", ".join(to_user)}]) AS r2, list_min([{", ".join(to_assistant)}]) AS r3
                    FROM repairs JOIN judged ON judged.conv_id IS NOT DISTINCT FROM repairs.conv_id AND judged.place = repairs.place + 1
                )
            )
        ), ended AS (
            SELECT conv_id, list_min([s0, s3]) AS way FROM repairs
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1
        ), faults AS (
            SELECT conv_id, coalesce(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT_IF(blank) AS blank,
                   COUNT_IF(duplicate) AS duplicate, SUM(truncated) AS truncated,
                   COUNT_IF(before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM judged GROUP BY conv_id
        )
        SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
               CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
               CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, way.c AS cost, way.a AS audit,
               sha256(substr(way.o, 2)) AS repaired_sha256
        FROM ended e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id"""


# What SQL can express; the others are tested against brute force, exact round
# trips, or held-out accuracy.
ORACLE: dict[str, str] = {
    "op3_signature_join": _sql_near_duplicates(jaccard.WORDS, jaccard.PERCENT),
    "op5_url_cascade": rf"""
        WITH rules(rule, verdict) AS (VALUES {_LISTED}), parsed AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), fitting AS (
            SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
            FROM parsed JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
                AND starts_with(path, substr(rule, strpos(rule, '/')))
            GROUP BY page_id
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM parsed LEFT JOIN fitting USING (page_id)""",
    "op8_chat_tree": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL
            SELECT * FROM (VALUES {", ".join(map(str, EXTRA_CONVERSATION))})
        )
        SELECT conv_id, COUNT(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(SUM(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(SUM({len(chat.START + chat.SEP + chat.END)} + {_written_chars("role")} + {_written_chars("text")})
                    AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id""",
    "op9_rule_cascade": rf"""
        WITH split AS (
            SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS words,
                   [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
            FROM documents
        ), windows AS (
            SELECT doc_id, unnest(generate_series(1, len(words) - 7)) AS place, words FROM split WHERE len(words) > 7
        ), twice AS (
            SELECT doc_id, place FROM (SELECT doc_id, place, list_slice(words, place, place + 7) AS seen FROM windows)
            QUALIFY COUNT(*) OVER (PARTITION BY doc_id, seen) > 1
        ), covered AS (
            SELECT doc_id, CAST(SUM(added) AS BIGINT) AS n FROM (
                SELECT doc_id, least(8, coalesce(lead(place) OVER (PARTITION BY doc_id ORDER BY place) - place, 8)) AS added
                FROM twice
            ) GROUP BY doc_id
        ), measured AS (
            SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
                   len([1 FOR pair IN list_zip(words[2:], words[:-2]) IF pair[1] = pair[2]]) AS n_same_words
            FROM split LEFT JOIN covered USING (doc_id)
        ), failed AS (
            SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT (100 * n_symbols > 10 * n_words)
               AND NOT (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines)
               AND NOT (100 * n_same_words > 30 * n_words)
               AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
        FROM failed""",
    "op11_superminhash": _sql_near_duplicates(
        minhash.WORDS, minhash.PERCENT, ", d.doc_id = MIN(reached.seen) AS kept"
    ),
    "op12_audit_repair": _sql_repair(),
    "op13_lookup_clusters": _sql_clusters(),
}
