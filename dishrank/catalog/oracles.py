"""DuckDB SQL for each query, written apart from the Spark code.

``VIEWS`` are common table expressions in order of need; an oracle names the
ones it uses and gets those and what they build on.
"""

from __future__ import annotations

import re

from . import registry
from .standins import ENDINGS, LEMMAS, LEXICON, MODIFIERS, STREAM_START, TEXT_DICTIONARY, UNSTORED_DISH


def _values(rows: list[tuple]) -> str:
    def literal(value):
        return f"'{value}'" if isinstance(value, str) else str(value)

    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


def _words(sentence: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({sentence}), '[^\\p{{L}}]+'), lambda w: w <> '')"


def _clip(sentence: str, term: str) -> str:
    return f"""CASE WHEN length({sentence}) > 300 THEN substr({sentence},
        1 + greatest(strpos({sentence}, {term}) - 151, 0),
        least(greatest(strpos({sentence}, {term}) - 151, 0) + 300, length({sentence}) - 1)
          - greatest(strpos({sentence}, {term}) - 151, 0))
      ELSE {sentence} END"""


def _singular(form: str) -> str:
    return f"""CASE WHEN length({form}) <= 3 THEN {form}
      WHEN length({form}) > 4 AND suffix({form}, 'ies') THEN left({form}, length({form}) - 3) || 'y'
      WHEN regexp_matches({form}, '(s|x|z|ch|sh)es$') THEN left({form}, length({form}) - 2)
      WHEN suffix({form}, 's') AND NOT regexp_matches({form}, '[sui]s$') THEN left({form}, length({form}) - 1)
      ELSE {form} END"""


def _hits(dictionary: str) -> str:
    """Tokens that name an item of one word: the word itself, its listed lemma, or its singular."""
    return f"""
SELECT review_id, sentence_pos, token_pos, dish, {_clip('sentence', 'dish')} AS promo_text
FROM word JOIN (
  SELECT form, dish FROM (
    SELECT f.form, i.item AS dish, rank FROM (
      SELECT form, form AS word, 0 AS rank FROM (SELECT DISTINCT form FROM word)
      UNION ALL SELECT form, lemma, 1 FROM lemma
      UNION ALL SELECT form, single, CASE WHEN single = {_singular('form')} THEN 2 ELSE 3 END FROM (
        SELECT form, unnest([
          CASE WHEN regexp_matches(form, '[^s]s$') THEN left(form, length(form) - 1) END,
          CASE WHEN regexp_matches(form, '(s|x|z|ch|sh)es$') THEN left(form, length(form) - 2) END,
          CASE WHEN regexp_matches(form, '[^aeiou]ies$') THEN left(form, length(form) - 3) || 'y' END]) AS single
        FROM (SELECT DISTINCT form FROM word) WHERE length(form) > 3 AND form NOT IN (SELECT form FROM lemma))
    ) f JOIN (SELECT DISTINCT item FROM {dictionary}) i ON f.word = i.item
  ) QUALIFY row_number() OVER (PARTITION BY form ORDER BY rank, dish) = 1
) USING (form)"""


def _score(total: str) -> str:
    return f"CAST(greatest(0, least(4, 2 + {total})) + 1 AS INT)"


def _confidence(n: str) -> str:
    return f"""CASE WHEN {n} < 10 THEN 0.55 WHEN {n} < 25 THEN 0.60 WHEN {n} < 50 THEN 0.65
      WHEN {n} < 75 THEN 0.70 WHEN {n} < 100 THEN 0.75 WHEN {n} < 125 THEN 0.80 WHEN {n} < 150 THEN 0.85
      WHEN {n} < 175 THEN 0.90 WHEN {n} < 500 THEN 0.95 ELSE 1.00 END::DOUBLE"""


def _trending(n: str) -> str:
    return f"""CASE WHEN {n} <= 4 THEN 0.4 WHEN {n} = 5 THEN 0.5 WHEN {n} = 6 THEN 0.6 WHEN {n} = 7 THEN 0.7
      WHEN {n} = 8 THEN 0.8 WHEN {n} = 9 THEN 0.9 ELSE 1.0 END::DOUBLE"""


def _one_decimal(x: str) -> str:
    return f"CAST(CAST(CAST({x} AS DECIMAL(18,9)) AS DECIMAL(18,1)) AS VARCHAR)"


def _snippet(text: str, term: str, half: int) -> str:
    size, at = f"length({text})", f"(strpos({text}, {term}) - 1)"
    start = f"(CASE WHEN {size} > {2 * half} THEN greatest({at} - {half}, 0) ELSE 0 END)"
    end = f"(CASE WHEN {size} > {2 * half} THEN least({at} + {half}, {size}) ELSE {size} END)"

    def between(a: str, b: str) -> str:
        a, b = (f"least(greatest({x}, 0), {size})" for x in (a, b))
        return f"substr({text}, 1 + least({a}, {b}), greatest({a}, {b}) - least({a}, {b}))"

    tail = f"CASE WHEN {size} > {2 * half} AND {end} <> {size} THEN '...' ELSE '' END"
    return f"""concat('"', {between(start, at)}, {term}, {between(f"{at} + length({term})", end)}, {tail}, '"')"""


# The place of a break is marked first, as the SQL engine's patterns know no look-behind.
_MARKED = r"""regexp_replace(text, '([.!?][''"]?)(\s)', '\1' || chr(1) || '\2', 'g')"""

VIEWS = {
    "business": """
SELECT CAST(s_suppkey AS VARCHAR) AS business_id, s_name AS name,
  concat(s_name, chr(92), 'n', replace(n_name, '_', ' ')) AS full_address,
  replace(n_name, '_', ' ') AS city, upper(substr(r_name, 1, 2)) AS state,
  CAST(1 + (s_suppkey % 9) * 0.5 AS DOUBLE) AS stars, CAST(s_suppkey * 7 % 300 AS BIGINT) AS review_count
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "dictionary": """
SELECT DISTINCT unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) AS category, p_name AS item FROM part""",
    "mention": """
SELECT CAST(l_suppkey AS VARCHAR) AS business_id, p_name AS dish,
  CAST(1 + (l_orderkey + l_linenumber) % 5 AS INT) AS score,
  concat(p_name, ' in order ', CAST(l_orderkey AS VARCHAR)) AS promo_text,
  CAST(l_shipdate AS DATE) AS promo_date,
  CASE WHEN l_returnflag = 'R' THEN 'tip' ELSE 'review' END AS kind
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "review": """
SELECT CAST(doc_id % 10 AS VARCHAR) AS business_id, text,
  concat('2024-', lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0'), '-', lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0')) AS date,
  concat('review-', doc_id) AS review_id
FROM documents""",
    "tip": """
SELECT CAST(conv_id % 10 AS VARCHAR) AS business_id, text,
  concat('2024-', lpad(CAST(1 + conv_id % 12 AS VARCHAR), 2, '0'), '-', lpad(CAST(1 + conv_id % 28 AS VARCHAR), 2, '0')) AS date,
  concat('tip-', conv_id, '-', turn) AS review_id
FROM conversations""",
    "message": """
SELECT ts, event_id, concat(event_type, user_id) AS key,
  CASE WHEN event_id % 97 = 0 THEN concat(event_type, ',', user_id, ',broken')
    WHEN event_id % 11 = 0 THEN concat(event_type, ',', user_id, ',NATION', user_id % 25, 'AF,', 1 + event_id % 5)
    ELSE concat(event_type, ',', user_id, ',NATION', user_id % 25, 'AF,', 1 + event_id % 5, ',note ', event_id, ', with comma')
  END AS value
FROM events""",
    "text_dictionary": f"SELECT * FROM (VALUES {_values(TEXT_DICTIONARY)}) t(category, item)",
    "lemma": f"SELECT * FROM (VALUES {_values(LEMMAS)}) t(form, lemma)",
    "lexicon": f"SELECT * FROM (VALUES {_values(LEXICON)}) t(word, polarity)",
    "scores": """
SELECT business_id AS businessid, dish, CAST(sum(score) AS DOUBLE) / count(*) AS avgrating,
  CAST(sum(score) AS BIGINT) AS totalscore, count(*) AS numreviews,
  arg_max(promo_text, (score, promo_date, promo_text)) AS promotext, max(score) AS promoscore
FROM mention GROUP BY ALL""",
    "joined": "SELECT s.*, b.* EXCLUDE (business_id) FROM scores s JOIN business b ON s.businessid = b.business_id",
    "dishes": """
SELECT regexp_replace(city || state, '[, ]', '', 'g') AS citystate, dish, businessid, avgrating, numreviews,
  totalscore, promotext, promoscore FROM joined""",
    "businesses": """
SELECT DISTINCT business_id AS businessid, regexp_replace(city || state, '[, ]', '', 'g') AS citystate, name,
  full_address, city, state, stars, review_count AS reviewcount FROM business""",
    "rating": """
SELECT ts, event_id, str_split(value, ',')[1] AS dish, str_split(value, ',')[2] AS businessid,
  str_split(value, ',')[3] AS citystate, TRY_CAST(str_split(value, ',')[4] AS INT) AS score,
  coalesce(str_split(value, ',')[5], '') AS promotext
FROM message""",
    "valid": "SELECT * FROM rating WHERE score IS NOT NULL",
    "spread": """
SELECT *, unnest(generate_series(date_trunc('day', ts) - INTERVAL 13 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS ws
FROM valid""",
    "windows": f"""
SELECT CAST(ws AS TIMESTAMP) AS window_start, CAST(ws + INTERVAL 14 DAY AS TIMESTAMP) AS window_end,
  citystate, dish, businessid, count(*) AS num, CAST(sum(score) AS BIGINT) AS score,
  CAST(sum(score) AS DOUBLE) / count(*) AS avg, arg_min(promotext, (ts, promotext)) AS promotext,
  CASE WHEN count(*) = 1 THEN 0.0 ELSE sum(score)::DOUBLE * {_trending('count(*)')} END AS weighted
FROM spread GROUP BY ws, citystate, dish, businessid""",
    "trending": """
SELECT *, CAST(row_number() OVER (PARTITION BY window_end, citystate ORDER BY weighted DESC, dish, businessid) AS INT) AS rank
FROM windows QUALIFY rank <= 3""",
    "trends": """
SELECT citystate, dish, businessid, num AS numreviews, score AS totalscore, avg AS avgrating, promotext
FROM trending QUALIFY window_end = max(window_end) OVER (PARTITION BY citystate)""",
    "stored": f"""
SELECT citystate, dish, businessid, CAST(sum(score) AS DOUBLE) / count(*) AS avgrating, count(*) AS numreviews,
  CAST(sum(score) AS BIGINT) AS totalscore, max(promotext) AS promotext, max(score) AS promoscore
FROM valid WHERE ts < TIMESTAMP '{STREAM_START}' AND dish <> '{UNSTORED_DISH}' GROUP BY citystate, dish, businessid""",
    "delta": f"""
SELECT citystate, dish, businessid, count(*) AS num, CAST(sum(score) AS BIGINT) AS score
FROM valid WHERE ts >= TIMESTAMP '{STREAM_START}' GROUP BY ALL""",
    "merged": """
SELECT s.citystate, s.dish, s.businessid,
  CASE WHEN d.num IS NULL THEN s.avgrating ELSE CAST(s.totalscore + d.score AS DOUBLE) / (s.numreviews + d.num) END AS avgrating,
  s.numreviews + coalesce(d.num, 0) AS numreviews, s.totalscore + coalesce(d.score, 0) AS totalscore,
  s.promotext, s.promoscore
FROM stored s LEFT JOIN delta d USING (citystate, dish, businessid)""",
    "completion": """
SELECT split_part(p_name, ' ', 2) AS type, p_name AS value FROM part
UNION ALL SELECT lower(p_type), concat(lower(p_type), ' ', split_part(p_name, ' ', 2)) FROM part""",
    "sentence_list": rf"""
SELECT review_id, list_transform(list_filter(list_transform(string_split({_MARKED}, chr(1)),
    lambda s: regexp_replace(s, '^[.!?\s]+', '')), lambda s: s <> ''),
  lambda s: regexp_replace(s, '\p{{C}}', '', 'g')) AS ss FROM review""",
    "sentence": "SELECT review_id, CAST(i - 1 AS INT) AS sentence_pos, ss[i] AS sentence FROM (SELECT *, unnest(generate_series(1, len(ss))) AS i FROM sentence_list)",
    "word": f"""
SELECT review_id, sentence_pos, CAST(i - 1 AS INT) AS token_pos, ws[i] AS form, sentence FROM (
  SELECT *, unnest(generate_series(1, len(ws))) AS i FROM (SELECT *, {_words('sentence')} AS ws FROM sentence))""",
    "token": f"""
SELECT w.*, coalesce(l.lemma, {_singular('w.form')}) AS lemma FROM word w LEFT JOIN lemma l USING (form)""",
    "hit": _hits("text_dictionary"),
    "hit_total": f"""
SELECT review_id, sentence_pos, token_pos, CAST(sum(polarity) AS INT) AS total
FROM (SELECT *, unnest({_words('promo_text')}) AS w FROM hit) JOIN lexicon ON w = lexicon.word GROUP BY ALL""",
    "hit_score": f"""
SELECT h.*, {_score('coalesce(total, 0)')} AS score FROM hit h
LEFT JOIN hit_total USING (review_id, sentence_pos, token_pos)""",
    "word_dictionary": "SELECT DISTINCT form AS item FROM word WHERE length(form) >= 7",
    "modifier": f"SELECT * FROM (VALUES {_values(MODIFIERS)}) t(word, kind, factor)",
    "modified": "SELECT review_id, sentence_pos, token_pos, kind, CAST(factor AS DOUBLE) AS factor FROM word JOIN modifier ON form = modifier.word",
    "ending_table": f"""
SELECT form, min(lemma) AS lemma, left(md5(form), 1) >= '8' AS held_out FROM (
  SELECT form, left(form, length(form) - length(ending)) || becomes AS lemma
  FROM (SELECT DISTINCT form FROM word WHERE length(form) >= 3), (VALUES {_values(ENDINGS)}) e(ending, becomes)
  WHERE suffix(form, ending))
WHERE lemma IN (SELECT form FROM word WHERE length(form) >= 3) GROUP BY form""",
    "suffix_rule": """
SELECT ending, becomes, pairs FROM (
  SELECT *, sum(pairs) OVER (PARTITION BY ending) AS every FROM (
    SELECT substr(form, start + 1) AS ending, substr(lemma, start + 1) AS becomes, count(*) AS pairs FROM (
      SELECT form, lemma, unnest(generate_series(greatest(shared - 3, 2), shared)) AS start FROM (
        SELECT form, lemma, list_max(list_filter(generate_series(1, least(length(form), length(lemma))),
          lambda n: left(form, n) = left(lemma, n))) AS shared FROM ending_table WHERE NOT held_out)
      WHERE shared >= 2)
    WHERE length(form) - start BETWEEN 1 AND 8 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY ending ORDER BY pairs DESC, becomes) = 1)
WHERE pairs >= 3 AND pairs >= 0.5 * every""",
    "pair_dictionary": """
SELECT DISTINCT a.form || ' ' || b.form AS item, a.form AS w1, b.form AS w2 FROM word a
JOIN word b ON a.review_id = b.review_id AND a.sentence_pos = b.sentence_pos AND a.token_pos = 0 AND b.token_pos = 1""",
    "pair_form": f"""
SELECT form, word FROM (
  SELECT f.form, v.word, rank FROM (
    SELECT form, form AS word, 0 AS rank FROM (SELECT DISTINCT form FROM word)
    UNION ALL SELECT form, lemma, 1 FROM lemma
    UNION ALL SELECT form, single, CASE WHEN single = {_singular('form')} THEN 2 ELSE 3 END FROM (
      SELECT form, unnest([
        CASE WHEN regexp_matches(form, '[^s]s$') THEN left(form, length(form) - 1) END,
        CASE WHEN regexp_matches(form, '(s|x|z|ch|sh)es$') THEN left(form, length(form) - 2) END,
        CASE WHEN regexp_matches(form, '[^aeiou]ies$') THEN left(form, length(form) - 3) || 'y' END]) AS single
      FROM (SELECT DISTINCT form FROM word) WHERE length(form) > 3 AND form NOT IN (SELECT form FROM lemma))
  ) f JOIN (SELECT w1 AS word FROM pair_dictionary UNION SELECT w2 FROM pair_dictionary) v ON f.word = v.word
) QUALIFY row_number() OVER (PARTITION BY form ORDER BY rank, word) = 1""",
    "pair_token": """
SELECT review_id, sentence_pos, token_pos, sentence, pair_form.word AS w1,
  CASE WHEN lead(token_pos) OVER spot = token_pos + 1 THEN lead(pair_form.word) OVER spot END AS w2
FROM word JOIN pair_form USING (form)
WINDOW spot AS (PARTITION BY review_id, sentence_pos ORDER BY token_pos)""",
    "pair_hit": "SELECT review_id, sentence_pos, token_pos, sentence, item AS dish FROM pair_token JOIN pair_dictionary USING (w1, w2)",
    "last_hit": "SELECT * FROM hit_score QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY sentence_pos DESC, token_pos DESC) = 1",
}


def _pattern(name: str) -> re.Pattern:
    return re.compile(rf"\b(?:FROM|JOIN)\s+{name}\b")


def _needed(sql: str, views: dict[str, str]) -> list[str]:
    """Views ``sql`` builds on, in their order of definition."""
    wanted: set[str] = set()
    open_texts = [sql]
    while open_texts:
        text = open_texts.pop()
        for name, body in views.items():
            if name not in wanted and _pattern(name).search(text):
                wanted.add(name)
                open_texts.append(body)
    return [name for name in views if name in wanted]


def _with(sql: str, views: dict[str, str] = VIEWS) -> str:
    names = _needed(sql, views)
    if not names:
        return sql
    return "WITH " + ",\n".join(f"{name} AS ({views[name]})" for name in names) + "\n" + sql


_FIELDS = f"""dish, businessid, {_one_decimal('avgrating')} AS avgrating, numreviews AS dishnumreviews, promotext,
  replace(full_address, chr(92) || 'n', ' ') AS address, name, reviewcount AS restaurantnumreviews, stars"""

_RATED = f"(SELECT *, avgrating * {_confidence('numreviews')} AS weighted FROM dishes WHERE avgrating >= 3.5)"

_SEARCH = f"""
SELECT citystate, term, rank, {_FIELDS} FROM (
  SELECT r.*, category AS term,
    CAST(row_number() OVER (PARTITION BY citystate, category ORDER BY weighted DESC, dish, businessid) AS INT) AS rank
  FROM {_RATED} r JOIN dictionary ON dish = item QUALIFY rank <= 4)
JOIN businesses USING (citystate, businessid)"""

_CLOSED = "window_end <= (SELECT max(ts) FROM valid) - INTERVAL 1 DAY"

# The trends after the second write: rated again wins, the others stay.
_REPLACED = f"""
WITH early AS (SELECT * FROM trending WHERE window_end <= TIMESTAMP '{STREAM_START}'),
again AS (SELECT * FROM trending WHERE citystate IN (
  SELECT citystate FROM valid WHERE ts > (SELECT max(ts) FROM valid) - INTERVAL 1 HOUR)),
both_parts AS (SELECT * FROM again UNION ALL
  SELECT * FROM early WHERE citystate NOT IN (SELECT citystate FROM again))
SELECT citystate, dish, businessid, num AS numreviews, score AS totalscore, avg AS avgrating, promotext
FROM both_parts QUALIFY window_end = max(window_end) OVER (PARTITION BY citystate)"""

_DISH_KEY = "citystate, dish, businessid"

_COMPLETION_KEYED = """
SELECT p_partkey, split_part(p_name, ' ', 2) AS type, p_name AS value FROM part
UNION ALL SELECT p_partkey, lower(p_type), concat(lower(p_type), ' ', split_part(p_name, ' ', 2)) FROM part"""

_RESPONSE = """
SELECT p_partkey, CAST(to_json({result_list: [
  {result_type: 'dish', completion_list: [{type: split_part(p_name, ' ', 2), value: p_name},
    {type: lower(p_type), value: concat(lower(p_type), ' ', split_part(p_name, ' ', 2))}]},
  {result_type: 'restaurant', completion_list: [{type: 'brand', value: p_brand}]}]}) AS VARCHAR) AS json FROM part"""

ORACLES = {
    "read_reviews": "SELECT business_id, text, date FROM review",
    "read_tips": "SELECT business_id, text, date FROM tip",
    "read_businesses": "SELECT *, CASE WHEN stars >= 3 THEN 'Restaurants|' ELSE '' END || state AS categories FROM business",
    "restaurants_only": "SELECT * FROM business WHERE stars >= 3",
    "dictionary_terms": "SELECT category, item FROM dictionary",
    "list_dishes": "SELECT DISTINCT item FROM dictionary ORDER BY item",
    "category_items": "SELECT category, item, count(*) OVER (PARTITION BY category) AS n_items FROM dictionary",
    "category_expand": """
SELECT citystate, category AS term, b.item AS dish FROM (
  SELECT DISTINCT citystate, category FROM dishes JOIN dictionary ON dish = item) JOIN dictionary b USING (category)""",
    "publish_dishes": "SELECT * FROM dishes",
    "publish_businesses": "SELECT * FROM businesses WHERE businessid IN (SELECT businessid FROM scores)",
    "business_keys": "SELECT businessid, citystate FROM businesses WHERE businessid IN (SELECT businessid FROM scores)",
    "dishes_limit": f"SELECT * FROM dishes ORDER BY {_DISH_KEY} LIMIT 1000",
    "dishes_by_city": f"SELECT * FROM dishes WHERE citystate = '{registry.SHOWN_CITYSTATE}'",
    "dishes_by_city_dish": f"""
SELECT * FROM dishes WHERE citystate = '{registry.SHOWN_CITYSTATE}' AND dish = '{registry.SHOWN_DISH}'""",
    "dishes_by_business": f"""
SELECT * FROM dishes WHERE citystate = '{registry.SHOWN_CITYSTATE}'
  AND businessid = (SELECT min(businessid) FROM dishes WHERE citystate = '{registry.SHOWN_CITYSTATE}')""",
    "dishes_of_business": f"SELECT * FROM dishes WHERE businessid = '{registry.SHOWN_BUSINESS}'",
    "places_of_dish": f"""
SELECT citystate, {_FIELDS} FROM (SELECT * FROM dishes WHERE dish = '{registry.SHOWN_DISH}') JOIN businesses USING (citystate, businessid)""",
    "stage_roundtrip": "SELECT * FROM scores",
    "stage_resumed": "SELECT * FROM scores",
    "joined_persisted": "SELECT citystate, businessid, b.name, dish, numreviews FROM dishes JOIN businesses b USING (citystate, businessid)",
    "completions_checked": f"SELECT type, value FROM ({_COMPLETION_KEYED}) WHERE p_partkey % 50 NOT IN (1, 2, 3)",
    "completions_quarantine": f"""
SELECT CASE p_partkey % 50 WHEN 1 THEN left(json, length(json) // 2) WHEN 2 THEN '  '
    ELSE concat('{{"status": "', p_partkey, '"}}') END AS value,
  CASE p_partkey % 50 WHEN 1 THEN 'malformed' WHEN 2 THEN 'empty' ELSE 'no results' END AS reason
FROM ({_RESPONSE}) WHERE p_partkey % 50 IN (1, 2, 3)""",
    "completions_parse": "SELECT type, value FROM completion",
    "completions_by_type": """
SELECT type, value, count(*) OVER (PARTITION BY type) AS n_values FROM (SELECT DISTINCT type, value FROM completion)""",
    "completions_export": "SELECT DISTINCT concat(type, ',', value) AS line FROM completion",
    "citystate_key": """
SELECT business_id, regexp_replace(city || state, '[, ]', '', 'g') AS stored,
  replace(replace(concat(city, ', ', state), ',', ''), ' ', '') AS looked_up FROM business""",
    "clean_address": "SELECT business_id, replace(full_address, chr(92) || 'n', ' ') AS address FROM business",
    "format_rating": f"SELECT businessid, dish, {_one_decimal('avgrating')} AS avgrating FROM scores",
    "round_rating": "SELECT businessid, dish, CAST(round(CAST(avgrating AS DECIMAL(18,9)), 2) AS DECIMAL(18,2))::VARCHAR AS rounded FROM scores",
    "trending_weight": f"""
SELECT businessid, dish, {_trending('numreviews')} AS weight,
  CASE WHEN numreviews = 1 THEN 0.0 ELSE totalscore::DOUBLE * {_trending('numreviews')} END AS weighted FROM scores""",
    "confidence_weight": f"SELECT businessid, dish, numreviews, {_confidence('numreviews')} AS weight FROM scores",
    "list_cities": """
SELECT DISTINCT citystate, concat(left(citystate, length(citystate) - 2), ', ', right(citystate, 2)) AS label
FROM dishes ORDER BY citystate""",
    "promo_snippet": f"""
SELECT business_id, promo_text, {_snippet('promo_text', 'dish', 23)} AS in_list, {_snippet('longer', 'dish', 18)} AS in_search
FROM (SELECT *, concat('they say the ', promo_text, ' is good') AS longer FROM mention)""",
    "sentences": "SELECT review_id, sentence_pos, sentence FROM sentence",
    "tokens": "SELECT review_id, sentence_pos, token_pos, form, lemma FROM token",
    "clip_sentence": f"""
SELECT review_id, sentence_pos, {_clip('sentence', f"'{registry.TEXT_TERM}'")} AS clipped FROM sentence""",
    "term_mentions": "SELECT review_id, sentence_pos, token_pos, dish FROM hit",
    "last_mention": "SELECT review_id, sentence_pos, dish, promo_text FROM last_hit",
    "first_mention": """
SELECT review_id, sentence_pos, dish, promo_text FROM hit
QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY sentence_pos, token_pos DESC) = 1""",
    "mentions_scored": "SELECT DISTINCT review_id, sentence_pos, dish, score FROM hit_score",
    "sentence_sentiment": f"""
SELECT review_id, sentence_pos, {_score('coalesce(CAST(sum(polarity) AS INT), 0)')} AS score
FROM sentence LEFT JOIN (SELECT review_id, sentence_pos, polarity FROM word JOIN lexicon ON form = lexicon.word)
USING (review_id, sentence_pos) GROUP BY review_id, sentence_pos""",
    "sentence_sentiment_composed": f"""
SELECT review_id, sentence_pos, {_score('CAST(round(coalesce(total, 0)) AS INT)')} AS score FROM sentence LEFT JOIN (
  SELECT review_id, sentence_pos, sum(polarity * CASE WHEN negators % 2 = 1 THEN -1 ELSE 1 END * factor) AS total FROM (
    SELECT w.*, (SELECT count(*) FROM modified m WHERE m.review_id = w.review_id AND m.sentence_pos = w.sentence_pos
        AND m.kind = 'negate' AND m.token_pos BETWEEN w.token_pos - 3 AND w.token_pos - 1
        AND NOT EXISTS (SELECT 1 FROM modified c WHERE c.review_id = w.review_id AND c.sentence_pos = w.sentence_pos
          AND c.kind = 'clause' AND c.token_pos BETWEEN m.token_pos AND w.token_pos - 1)) AS negators,
      coalesce((SELECT arg_max(factor, token_pos) FROM modified m WHERE m.review_id = w.review_id
        AND m.sentence_pos = w.sentence_pos AND m.kind = 'intensify'
        AND m.token_pos BETWEEN w.token_pos - 2 AND w.token_pos - 1), 1.0) AS factor
    FROM (SELECT review_id, sentence_pos, token_pos, length(form) % 5 - 2 + CASE WHEN length(form) >= 9 THEN 1 ELSE 0 END AS polarity
      FROM word) w)
  GROUP BY review_id, sentence_pos) USING (review_id, sentence_pos)""",
    "lemma_suffix_rules": "SELECT ending, becomes, pairs FROM suffix_rule",
    "learned_lemmas": """
SELECT form, listed, lemma FROM (SELECT form, lemma AS listed FROM ending_table WHERE held_out) LEFT JOIN (
  SELECT form, left(form, length(form) - size) || becomes AS lemma FROM (
    SELECT form, unnest(generate_series(1, least(8, length(form) - 2))) AS size FROM ending_table WHERE held_out)
  JOIN suffix_rule ON ending = right(form, size) QUALIFY row_number() OVER (PARTITION BY form ORDER BY size DESC) = 1)
USING (form)""",
    "longest_sentence_sentiment": f"""
SELECT review_id, any_value(sentence) AS sentence, {_score('coalesce(CAST(sum(polarity) AS INT), 0)')} AS score
FROM (SELECT * FROM sentence QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY length(sentence) DESC, sentence_pos) = 1)
LEFT JOIN (SELECT review_id, sentence_pos, polarity FROM word JOIN lexicon ON form = lexicon.word) USING (review_id, sentence_pos)
GROUP BY review_id""",
    "mentions_large_dictionary": f"SELECT DISTINCT review_id, sentence_pos, dish FROM ({_hits('word_dictionary')})",
    "mentions_ngram": f"""
SELECT review_id, sentence_pos, dish, {_clip('sentence', 'dish')} AS promo_text
FROM pair_hit QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY sentence_pos DESC, token_pos DESC) = 1""",
    "sentiment_large_lexicon": f"""
SELECT review_id, sentence_pos, {_score('coalesce(CAST(sum(polarity) AS INT), 0)')} AS score
FROM sentence LEFT JOIN (SELECT review_id, sentence_pos, polarity FROM word JOIN (
  SELECT form, length(form) % 5 - 2 + CASE WHEN length(form) >= 9 THEN 1 ELSE 0 END AS polarity
  FROM (SELECT DISTINCT form FROM word)) USING (form))
USING (review_id, sentence_pos) GROUP BY review_id, sentence_pos""",
    "text_contains": f"SELECT review_id, business_id FROM review WHERE contains(text, '{registry.TEXT_TERM}')",
    "sample_rows": f"""
SELECT review_id, business_id, date FROM review
WHERE CAST('0x' || left(md5(review_id), 8) AS BIGINT) < {int(registry.SAMPLE_FRACTION * 2**32)}""",
    "take_sample": f"""
SELECT * FROM scores ORDER BY md5(concat('0', chr(31), businessid, chr(31), dish)), businessid, dish LIMIT {registry.SAMPLE_ROWS}""",
    "take_large_sample": f"""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
ORDER BY md5(concat('7', chr(31), l_orderkey, chr(31), l_linenumber)), l_orderkey LIMIT {registry.LARGE_SAMPLE_ROWS}""",
    "dish_scores": "SELECT * FROM scores",
    "best_quote": """
SELECT business_id, dish, arg_max(promo_text, (score, promo_date, promo_text)) AS promotext, max(score) AS promoscore,
  CAST(arg_max(promo_date, (score, promo_date, promo_text)) AS VARCHAR) AS promodate FROM mention GROUP BY business_id, dish""",
    "reviews_union_tips": "SELECT * REPLACE (CAST(promo_date AS VARCHAR) AS promo_date) FROM mention",
    "scores_join_business": "SELECT * FROM joined",
    "multi_review_dishes": f"SELECT * FROM dishes WHERE numreviews > 1 ORDER BY {_DISH_KEY} LIMIT 20",
    "business_sql_view": "SELECT business_id, city, state, stars FROM business",
    "category_filter": """
SELECT p_partkey, replace(p_name, ' ', '|') AS categories FROM part WHERE list_contains(string_split(p_name, ' '), 'bolt')""",
    "enrich_recommendations": f"""
SELECT citystate, {_FIELDS} FROM {_RATED} JOIN businesses USING (citystate, businessid)""",
    "search_dishes": _SEARCH,
    "search_requests": _SEARCH,
    "recommendations_json": f"""
SELECT citystate, term, rank, CAST(to_json({{dish: dish, businessid: businessid, avgrating: avgrating,
  dishnumreviews: dishnumreviews, promotext: promotext, address: address, name: name,
  restaurantnumreviews: restaurantnumreviews, stars: stars}}) AS VARCHAR) AS json FROM ({_SEARCH})""",
    "search_one_city": f"""
SELECT * EXCLUDE (citystate, term, rank) FROM ({_SEARCH})
WHERE citystate = '{registry.SHOWN_CITYSTATE}' AND term = 'blue'""",
    "top_dishes_for_restaurant": f"""
SELECT citystate, rank, {_FIELDS} FROM (SELECT *, CAST(row_number() OVER (
    PARTITION BY citystate, businessid ORDER BY weighted DESC, dish, businessid) AS INT) AS rank
  FROM {_RATED} QUALIFY rank <= 3) JOIN businesses USING (citystate, businessid)""",
    "top_dishes_by_city": f"""
SELECT citystate, rank, dish, businessid, {_one_decimal('avgrating')} AS avgrating, numreviews AS dishnumreviews, promotext,
  concat(citystate, ' ', businessid) AS address, concat('Place ', businessid) AS name,
  CAST(businessid AS BIGINT) * 7 % 300 AS restaurantnumreviews,
  CAST(1 + (CAST(businessid AS BIGINT) % 9) * 0.5 AS DOUBLE) AS stars
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY citystate ORDER BY dish, businessid) AS INT) AS rank
  FROM trends QUALIFY rank <= 3)""",
    "parse_ratings": """
SELECT event_id, dish, businessid, citystate, coalesce(CAST(score AS VARCHAR), '') AS score, promotext,
  score IS NOT NULL AS valid FROM rating""",
    "encode_ratings": """
SELECT concat(dish, businessid) AS key, concat(dish, ',', businessid, ',', citystate, ',', score, ',', promotext) AS value FROM valid""",
    "window_ratings": "SELECT * FROM windows",
    "trending_top3": "SELECT * FROM trending",
    "merge_ratings": "SELECT * FROM merged",
    "replace_trends": _REPLACED,
    "stream_trending": f"SELECT * FROM windows WHERE {_CLOSED}",
    "stream_apply": "SELECT * FROM merged",
    "stream_trends": f"""
SELECT citystate, dish, businessid, num AS numreviews, score AS totalscore, avg AS avgrating, promotext
FROM (SELECT * FROM trending WHERE {_CLOSED}) QUALIFY window_end = max(window_end) OVER (PARTITION BY citystate)""",
    "stream_late": """
SELECT event_id, dish, businessid, citystate, score FROM valid WHERE ts < TIMESTAMP '2024-01-22'
AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM valid) - INTERVAL 1 DAY""",
    "stream_bad_clocks": f"SELECT * FROM windows WHERE {_CLOSED}",
    "stream_refused": f"""
SELECT ts, event_id, key, value FROM message WHERE event_id % 97 = 0
UNION ALL SELECT TIMESTAMP '{registry.BAD_CLOCK}', event_id, key, value FROM message WHERE event_id % {registry.BAD_CLOCK_EVERY} = 0""",
    "stream_live_trends": """
SELECT citystate, dish, businessid, num AS numreviews, score AS totalscore, avg AS avgrating, promotext, window_end
FROM trending JOIN (SELECT citystate, date_trunc('day', max(ts)) + INTERVAL 1 DAY AS last FROM valid GROUP BY citystate)
USING (citystate) WHERE window_end = last""",
    "stream_quarantine": "SELECT ts, event_id, key, value FROM message WHERE event_id % 97 = 0",
}

# The batch job: the last mention of each text, of reviews and tips alike.
_BUILD_VIEWS = {
    **VIEWS,
    "review_text": "SELECT * FROM review UNION ALL SELECT * FROM tip",
    "sentence_list": VIEWS["sentence_list"].replace("FROM review", "FROM review_text"),
    "text_mention": """
SELECT business_id, dish, score, promo_text, CAST(date AS DATE) AS promo_date FROM last_hit JOIN review_text USING (review_id)""",
    "scores": VIEWS["scores"].replace("FROM mention", "FROM text_mention"),
}
_ORDER = [n for n in VIEWS if n not in ("scores", "joined", "dishes", "businesses")]
_ORDER.insert(_ORDER.index("sentence_list"), "review_text")
_ORDER += ["text_mention", "scores", "joined", "dishes"]


def oracle_sql() -> dict[str, str]:
    oracles = {key: _with(sql.strip()) for key, sql in ORACLES.items() if key != "replace_trends"}
    names = _needed(_REPLACED, VIEWS)
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in names)
    oracles["replace_trends"] = "WITH " + views + ",\n" + _REPLACED.strip().removeprefix("WITH ")
    oracles["build_dish_ratings"] = _with("SELECT * FROM dishes", {n: _BUILD_VIEWS[n] for n in _ORDER})
    return oracles
