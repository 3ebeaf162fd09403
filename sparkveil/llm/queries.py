"""Registered queries of the operators and their check SQL (DuckDB)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkveil.llm import bpe, chat, codes, exact, licenses, lines, mixing, neighbours, secrets, simhash, tokenids, toxicity, trie
from sparkveil.llm.common import join_counted, shared_folder, stored, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


HARD_TURN = r"\### Assistant: </turn> ok"


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as reply trees: each turn answers the one before it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(HARD_TURN))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(hard)
    node = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = rows.withColumn("node", node)
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select(F.col("conv_id").cast("string").alias("tree"), "node", parent.alias("parent"), "role", "text", F.lit(1.0).alias("score"))


@query(
    """
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
    ), lines AS (
        SELECT *,
            replace(replace(replace(replace(role, '\\', '\\b'), '###', '\\h'), '</turn>', '\\e'), ':', '\\c') AS safe_role,
            replace(replace(replace(text, '\\', '\\b'), '###', '\\h'), '</turn>', '\\e') AS safe_text
        FROM rows
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(4 + length(safe_role) + 2 + length(safe_text) + 8) AS BIGINT) AS formatted_chars
    FROM lines GROUP BY conv_id
    """
)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, formatted and read back from the output. Its tree is a chain: the best branch is all of it."""
    back = chat.read_back(chat.conversations(chat_messages(spark, sf_dir), branches=1))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        F.nullif("tree", F.lit("\0null")).cast("long").alias("conv_id"), "n_turns", F.sha2(F.encode(whole, "utf-8"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.encode("learned", "utf-8"), 256).alias("loss_sha256"), "formatted_chars",
    )


def _licenses_sql() -> str:
    templates = ", ".join(f"({n}, '{label}', list_distinct(string_split('{sentence}', ' ')))" for n, (label, sentence) in enumerate(licenses.TEMPLATES))
    cases = []
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        match = " AND ".join(f"w[i + {k}] = '{part}'" for k, part in enumerate(parts))
        cases.append(f"[x FOR x IN range(0, greatest(len(w) - {len(parts) - 1}, 0)) IF {match.replace('w[i', 'w[x + 1')}] AS at_{label}")
    return f"""
    WITH texts AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
        FROM documents
    ), base AS (SELECT doc_id, w, {", ".join(cases)} FROM texts
    ), templates(t, label, own) AS (VALUES {templates}
    ), blocks AS (
        SELECT doc_id, unnest([list_distinct(w[x * {licenses.STRIDE} + 1 : x * {licenses.STRIDE} + {licenses.WINDOW}]) FOR x IN range(0, (greatest(len(w), 1) - 1) // {licenses.STRIDE} + 1)]) AS b FROM texts
    ), hits AS (
        SELECT doc_id, label, len(list_intersect(own, b)) / len(own) AS c FROM blocks, templates
        WHERE len(list_intersect(own, b)) >= ceil(round({licenses.CONTAINMENT} * len(own), 9))
    ), best AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS c FROM hits GROUP BY doc_id
    ), named AS (
        SELECT base.*, [x FOR x IN ['apache', 'gpl', 'mit'] IF (x = 'mit' AND len(at_mit) > 0) OR (x = 'apache' AND len(at_apache) > 0) OR (x = 'gpl' AND len(at_gpl) > 0)] AS bl,
            list_concat(list_concat(at_mit, at_apache), at_gpl) AS places
        FROM base
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
        CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
        array_to_string(bl, ',') AS base_labels,
        array_to_string(list_sort(list_distinct(list_concat(bl, coalesce(labels, [])))), ',') AS labels,
        CASE WHEN len(bl) > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
    FROM named LEFT JOIN best USING (doc_id)
    """


@query(_licenses_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    every = F.concat(*(F.col(f"base.{label}") for _, label in licenses.PHRASES))
    return found.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


@query()
def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as compressed token ids, written and read back."""
    folder = shared_folder(spark)
    tokenids.write(table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return tokenids.read(spark, folder).select("doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query()
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query(
    """
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS n FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
        doc_id = min(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
    FROM t
    """
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document."""
    return exact.groups(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query()
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    rows = table(spark, sf_dir, "embeddings")
    found = neighbours.search(rows, rows.where("vec_id % 20 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query()
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    back = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest("decoded").alias("decoded_sha256"))


def mixing_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> mixing.WordModel:
    """Domains are the languages of labelled documents."""
    return mixing.fit(docs, table(spark, sf_dir, "labels"), F.col("lang"))


@query()
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and copies of every document at smoothed language weights."""
    docs = table(spark, sf_dir, "documents")
    found = mixing.mixed(docs.select("doc_id", "text"), mixing_model(spark, sf_dir, docs))
    return found.select("doc_id", "n_words", "shares", "rate", "copies")


@query(
    f"""
    WITH l AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents
    ), b AS (
        SELECT *, greatest(1, sum(regexp_matches(line, '[^\\x20\\x09-\\x0D]')::INT) OVER (PARTITION BY doc_id ORDER BY i)) AS pos FROM l
    ), u AS (SELECT doc_id, pos, string_agg(line, chr(10) ORDER BY i) AS line FROM b GROUP BY doc_id, pos
    ), h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS x FROM u
    ), r AS (
        SELECT *, (x + {lines.MULTIPLIER} * lag(x, 1, 0) OVER d) % {lines.SPAN} AS roll, lead(line) OVER d AS after FROM h WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
    ), pairs AS (
        SELECT doc_id, pos, row_number() OVER (PARTITION BY line, after ORDER BY doc_id NULLS FIRST, pos) > 1 AS again FROM r WHERE after IS NOT NULL
    ), gone AS (SELECT doc_id, pos FROM pairs WHERE again UNION SELECT doc_id, pos + 1 FROM pairs WHERE again
    ), marked AS (
        SELECT r.*, gone.pos IS NOT NULL AS gone, pos = max(pos) OVER (PARTITION BY doc_id) AS last FROM r LEFT JOIN gone USING (doc_id, pos)
    ), back AS (
        SELECT doc_id, count(*) AS n_lines, sum((last OR roll % {lines.DIVISOR} = 0)::INT) AS n_chunks, sum(gone::INT) AS removed_lines,
            coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS t
        FROM marked GROUP BY doc_id
    )
    SELECT doc_id, n_lines, CAST(n_chunks AS BIGINT) AS n_chunks, CAST(removed_lines AS BIGINT) AS removed_lines, sha256(t) AS text_sha256, CAST(length(t) AS BIGINT) AS n_chars FROM back
    """
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand in a row elsewhere before."""
    found = lines.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", "n_lines", "n_chunks", "removed_lines", F.sha2(F.encode(text, "utf-8"), 256).alias("text_sha256"), F.length(text).cast("long").alias("n_chars"))


@query()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


@query(
    """
    WITH RECURSIVE t AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
            length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS turn, length(coalesce(text, '')) AS chars
        FROM conversations WHERE conv_id IS NOT NULL
    ), own AS (SELECT conv_id, list({'id': sha256(turn), 'chars': chars} ORDER BY i) AS turns FROM t GROUP BY conv_id
    ), crc(conv_id, s, i, r) AS (
        SELECT conv_id, conv_id::VARCHAR, 0, 4294967295::BIGINT FROM own
        UNION ALL
        SELECT conv_id, s, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
        FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(r, ascii(s[i // 8 + 1])::BIGINT) ELSE r END AS x FROM crc WHERE i < 8 * length(s))
    ), h AS (SELECT conv_id, xor(r, 4294967295) % 6 AS h FROM crc WHERE i = 8 * length(s)
    ), full_ AS (
        SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:h], c.turns[h + 1:]) AS turns
        FROM own c JOIN h USING (conv_id) LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
    ), paths AS (
        SELECT conv_id, d, len(turns) AS n, [x.id FOR x IN turns[1:d]] AS path, CASE WHEN d = 0 THEN 0 ELSE turns[d].chars END AS chars
        FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM full_)
    ), nodes AS (
        SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
        FROM paths GROUP BY path, d
    ), children AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
    ), counted AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (path, d)
    ), above AS (SELECT *, unnest(range(0, d + 1)) AS up FROM counted
    ), totals AS (
        SELECT path[1:up] AS path, up AS d, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM above GROUP BY ALL
    )
    SELECT c.conv_id, CAST(c.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves,
        CAST(t.saved AS BIGINT) AS saved_tokens, c.ends_sha256
    FROM counted c JOIN totals t USING (path, d) LEFT JOIN nodes p ON p.d = c.d - 1 AND p.path = c.path[1:c.d - 1]
    """
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return trie.build(trie.rebuilt(trie.turns_of(table(spark, sf_dir, "conversations"))))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds, written out one after the other."""
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"""n{k} AS MATERIALIZED (
                SELECT vec_id, part, min(d).e AS e, min(d).d AS d FROM (
                    SELECT vec_id, v.part, {{'d': list_sum([(v.p[x] - b.p[x]) * (v.p[x] - b.p[x]) FOR x IN range(1, len(v.p) + 1)]), 'e': b.e}} AS d
                    FROM cut v JOIN b{k} b ON v.part = b.part
                ) GROUP BY vec_id, part
            )"""
        )
        if k < rounds:
            steps.append(
                f"""b{k + 1} AS MATERIALIZED (
                    SELECT b.part, b.e, coalesce(f.p, b.p) AS p FROM b{k} b LEFT JOIN (
                        SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY x) AS p FROM (
                            SELECT part, e, x, sum(p[x])::BIGINT AS s, count(*) AS n FROM (
                                SELECT cut.part, e, cut.p, unnest(range(1, len(cut.p) + 1)) AS x FROM cut JOIN n{k} USING (vec_id, part)
                            ) GROUP BY part, e, x
                        ) GROUP BY part, e
                    ) f USING (part, e)
                )"""
            )
    return f"""
    WITH v AS (
        SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), cut AS MATERIALIZED (
        SELECT vec_id, part, v[part * w + 1 : part * w + w] AS p FROM (SELECT vec_id, v, len(v) // {parts} AS w, unnest(range(0, {parts})) AS part FROM v)
    ), b0 AS MATERIALIZED (
        SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, p FROM cut WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries})
    ), {", ".join(steps)}, books AS (
        SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds}
    ), codes AS (
        SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{rounds} GROUP BY vec_id
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM codes JOIN v USING (vec_id), books
    """


@query(_codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, and the error of its label."""
    coded, codebooks = codes.compress(table(spark, sf_dir, "embeddings"), extra="label")
    label = F.coalesce(F.concat(F.lit("="), "extra"), F.lit(""))
    rows = stored(coded.select(F.col("id").alias("vec_id"), label.alias("label"), "code", "error", F.monotonically_increasing_id().alias("spot")))
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    digits = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return join_counted(rows, sums, "label", "spot").select(
        "vec_id", digits.alias("code"), "error", "label_error", F.lit(codes.codebooks_digest(codebooks)).alias("codebooks_sha256")
    )


def _secrets_sql() -> str:
    found = []
    for k, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        found.append(
            f"""SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, unnest(list_zip(regexp_extract_all(t, '{pattern}'), regexp_extract_all(t, '{pattern}', {rule.group}),
                string_split_regex(t, '{pattern}')[1:len(regexp_extract_all(t, '{pattern}'))])) AS m, unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS i, {rule.least} AS least FROM d"""
        )
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
    ), m AS ({" UNION ALL ".join(found)}
    ), places AS (
        SELECT *, sum(length(m[3]) + length(m[1])) OVER (PARTITION BY doc_id, k ORDER BY i) AS at_end FROM m
    ), spans AS (
        SELECT doc_id, k, kind, CAST(at_end - length(m[1]) AS BIGINT) AS at_start, kind || ':' || CAST(at_end - length(m[1]) AS BIGINT) || ':' || CAST(at_end AS BIGINT) AS span
        FROM places WHERE length(m[2]) >= least
    )
    SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        sha256(coalesce(string_agg(span, ',' ORDER BY at_start, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY at_start, k), '') AS spans
    FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
    """


@query(_secrets_sql())
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, through a new ledger."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), shared_folder(spark))
    base = [rule.kind for rule in secrets.BASE]
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(F.encode(written(F.filter("secrets", lambda s: s.kind.isin(base))), "utf-8"), 256)
    return found.select("doc_id", *map(of, base), digest.alias("base_sha256"), written("secrets").alias("spans"))
