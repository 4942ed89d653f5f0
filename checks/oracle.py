"""The registered queries in SQL over the given tables."""

from __future__ import annotations

from checks.driver_tables import PHONES
from checks.queries import NAME_MAPPING, PHONE_MAPPING

# Fixed values, the same as in the library: the stamp, problem characters, expected street types.
STAMP = "2024-01-01T00:00:00Z"
PROBLEM = r"""[=+/&<>;''"?%#$@,. \t\r\n]"""
EXPECTED = (
    "'Street','Avenue','Boulevard','Drive','Court','Place','Square','Lane','Road',"
    "'Trail','Parkway','Commons','Circle','Trace','Suite'"
)

NODES = f"""
nodes AS (
  SELECT p_partkey AS id, p_retailprice AS lat, CAST(p_size AS DOUBLE) AS lon, p_brand AS "user",
         CAST(p_size AS BIGINT) AS uid, '1' AS version, p_partkey % 100 AS changeset,
         '{STAMP}' AS "timestamp"
  FROM part)"""

WAYS = f"""
ways AS (
  SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS "user", o_custkey AS uid, '1' AS version,
         o_orderkey % 100 AS changeset, '{STAMP}' AS "timestamp"
  FROM orders)"""

WAYS_NODES = """
ways_nodes AS (
  SELECT l_orderkey AS id, l_partkey AS node_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey
              ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS "position"
  FROM lineitem)"""

RAW_TAGS = """
raw_tags AS (
  SELECT 'node' AS elem, p_partkey AS id, 'amenity' AS k, p_type || ' ' || p_size AS v FROM part
  UNION ALL SELECT 'node', p_partkey, 'kind', p_type FROM part
  UNION ALL SELECT 'node', p_partkey, 'building', CASE p_size % 3 WHEN 0 THEN 'place_of_worship'
                   WHEN 1 THEN 'restaurant' ELSE 'other' END FROM part
  UNION ALL SELECT 'node', p_partkey, 'religion', p_brand FROM part
  UNION ALL SELECT 'node', p_partkey, 'cuisine', p_type FROM part
  UNION ALL SELECT 'node', p_partkey, 'addr:zipcode', CAST(29980 + p_size AS VARCHAR) FROM part
  UNION ALL SELECT 'node', p_partkey, 'addr:city', p_brand FROM part
  UNION ALL SELECT 'node', p_partkey, 'name', p_name FROM part
  UNION ALL SELECT 'node', p_partkey, 'size.code', CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT 'node', p_partkey, 'contact:phone',
                   '(404) 555-' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 4, '0') FROM part
  UNION ALL SELECT 'node', p_partkey, 'addr:postcode', CAST(29980 + p_size AS VARCHAR) FROM part
  UNION ALL SELECT 'node', p_partkey, 'addr:street',
                   p_name || CASE p_size % 3 WHEN 0 THEN ' St.' WHEN 1 THEN ' Street' ELSE '' END FROM part
  UNION ALL SELECT 'node', p_partkey, 'note', p_name || ' & "' || p_brand || '" <''x''> ' FROM part
  UNION ALL SELECT 'way', o_orderkey, 'addr:postcode', CAST(29980 + o_custkey % 50 AS VARCHAR) FROM orders
  UNION ALL SELECT 'way', o_orderkey, 'order:priority:level', o_orderpriority FROM orders
  UNION ALL SELECT 'way', o_orderkey, 'Status', o_orderstatus FROM orders
  UNION ALL SELECT 'way', o_orderkey, 'phone',
                   '(678) 555-' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 4, '0') FROM orders)"""

RAW_KEYS = f"""{RAW_TAGS},
raw_keys AS (
  SELECT k FROM raw_tags
  UNION ALL SELECT event_type FROM events
  UNION ALL SELECT event_type || ':' || event_type FROM events
  UNION ALL SELECT p_name FROM part)"""

SPLITS = "regexp_matches(k, '^[a-z_]+:[a-z_]')"
KEY = f"CASE WHEN {SPLITS} THEN substr(k, strpos(k, ':') + 1) ELSE k END"
TYPE = f"CASE WHEN {SPLITS} THEN split_part(k, ':', 1) ELSE 'regular' END"


def phone(value: str) -> str:
    digits = f"regexp_replace({value}, '[^0-9]+', '', 'g')"
    head = f"ltrim(left({digits}, length({digits}) - 1), '0')"
    head = f"CASE WHEN {head} = '' THEN '0' ELSE {head} END"
    grouped = rf"reverse(rtrim(regexp_replace(reverse({head}), '(\d{{3}})', '\1-', 'g'), '-'))"
    return f"CASE WHEN length({digits}) > 1 THEN {grouped} || right({digits}, 1) END"


LOCAL_PHONE = "(lower(k) LIKE '%phone%' AND regexp_matches(v, '^[674(]'))"

TAGS = f"""{RAW_TAGS},
nodes_tags AS (
  SELECT id, {KEY} AS "key",
         CASE WHEN {LOCAL_PHONE} THEN coalesce({phone('v')}, v) ELSE v END AS "value",
         {TYPE} AS "type"
  FROM raw_tags WHERE elem = 'node' AND NOT regexp_matches(k, '{PROBLEM}')),
ways_tags AS (
  SELECT id, {KEY} AS "key", v AS "value", {TYPE} AS "type"
  FROM raw_tags WHERE elem = 'way' AND NOT regexp_matches(k, '{PROBLEM}')),
tags AS (SELECT * FROM nodes_tags UNION ALL SELECT * FROM ways_tags)"""

CONTRIBUTIONS = """
contributions AS (
  SELECT CAST(user_id AS VARCHAR) AS "user" FROM events
  UNION ALL SELECT CAST(o_custkey AS VARCHAR) FROM orders)"""

MARKUP_USERS = """
users AS (
  SELECT CAST(p_size AS BIGINT) AS uid FROM part
  UNION SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)"""

# All elements of the extract, with attribute values as text.
ELEMENTS = f"""{RAW_TAGS},
elements AS (
  SELECT 'node' AS name, CAST(p_partkey AS VARCHAR) AS id, CAST(p_retailprice AS VARCHAR) AS lat,
         CAST(p_size AS VARCHAR) AS lon, p_brand AS "user", CAST(p_size AS VARCHAR) AS uid,
         '1' AS version, CAST(p_partkey % 100 AS VARCHAR) AS changeset, '{STAMP}' AS "timestamp",
         NULL AS k, NULL AS v, NULL AS ref, NULL AS "type", NULL AS role FROM part
  UNION ALL SELECT 'way', CAST(o_orderkey AS VARCHAR), NULL, NULL, CAST(o_custkey AS VARCHAR),
         CAST(o_custkey AS VARCHAR), '1', CAST(o_orderkey % 100 AS VARCHAR), '{STAMP}',
         NULL, NULL, NULL, NULL, NULL FROM orders
  UNION ALL SELECT 'relation', CAST(c_custkey AS VARCHAR), NULL, NULL, c_name,
         CAST(c_custkey AS VARCHAR), '1', NULL, '{STAMP}', NULL, NULL, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'tag', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, k, v, NULL, NULL, NULL FROM raw_tags
  UNION ALL SELECT 'tag', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'type', c_mktsegment,
         NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'nd', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
         CAST(l_partkey AS VARCHAR), NULL, NULL FROM lineitem
  UNION ALL SELECT 'member', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
         CAST(c_nationkey AS VARCHAR), 'node', '' FROM customer
  UNION ALL SELECT 'member', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
         CAST(c_custkey AS VARCHAR), 'way', '' FROM customer
  UNION ALL SELECT 'bounds', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  UNION ALL SELECT 'map', NULL, NULL, NULL, NULL, NULL, '0.6', NULL, NULL, NULL, NULL, NULL, NULL, NULL)"""

TOP_LEVEL = """
tops AS (
  SELECT name, id, row_number() OVER (ORDER BY section, id) - 1 AS element FROM (
    SELECT 'node' AS name, p_partkey AS id, 1 AS section FROM part
    UNION ALL SELECT 'way', o_orderkey, 2 FROM orders
    UNION ALL SELECT 'relation', c_custkey, 3 FROM customer))"""

DIRTY = """
dirty AS (
  SELECT CASE WHEN p_partkey % 97 = 0 THEN 'x' ELSE '' END || p_partkey AS id, nodes.lat, nodes.lon,
         CASE WHEN p_partkey % 89 <> 0 THEN p_brand END AS "user", uid, version, changeset, "timestamp"
  FROM nodes JOIN part ON nodes.id = p_partkey),
checked AS (
  SELECT *, CASE WHEN id LIKE 'x%' THEN 'type:id' END AS bad_id,
         CASE WHEN "user" IS NULL THEN 'required:user' END AS bad_user FROM dirty)"""


def validated(columns: str) -> str:
    """Rows per table whose whole element passes, and the others."""
    node = "p_partkey % 97 = 0 OR p_partkey % 89 = 0 OR p_partkey % 83 = 0 OR p_partkey % 79 = 0"
    way = """o_orderkey % 101 = 0 OR o_orderkey % 103 = 0 OR o_orderkey % 107 = 0
             OR o_orderkey % 109 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)"""
    return f"""WITH {TAGS},
        bad_nodes AS (SELECT p_partkey AS id FROM part WHERE {node}),
        bad_ways AS (SELECT o_orderkey AS id FROM orders WHERE {way}),
        rows AS (
          SELECT 'nodes' AS table_name, p_partkey IN (SELECT id FROM bad_nodes) AS bad FROM part
          UNION ALL SELECT 'nodes_tags', id IN (SELECT id FROM bad_nodes) FROM nodes_tags
          UNION ALL SELECT 'ways', o_orderkey IN (SELECT id FROM bad_ways) FROM orders
          UNION ALL SELECT 'ways_nodes', l_orderkey IN (SELECT id FROM bad_ways) FROM lineitem
          UNION ALL SELECT 'ways_tags', id IN (SELECT id FROM bad_ways) FROM ways_tags),
        counted AS (
          SELECT table_name, count(*) FILTER (NOT bad) AS kept, count(*) FILTER (bad) AS rejected, 0 AS orphans
          FROM rows GROUP BY table_name)
        SELECT table_name, {columns} FROM counted"""


def replaced(column: str, mapping: dict[str, str]) -> str:
    for key in sorted(mapping, key=lambda k: (-len(k), k)):
        column = f"replace({column}, '{key}', '{mapping[key]}')"
    return column


def value_counts(tags: str, condition: str, limit: str = "") -> str:
    order = f'ORDER BY n DESC, "value" {limit}' if limit else ""
    return f"""WITH {TAGS}
        SELECT "value", count(*) AS n FROM {tags} WHERE {condition} GROUP BY "value" {order}"""


def value_counts_for(value: str, key: str) -> str:
    return f"""WITH {TAGS}
        SELECT t."value", count(*) AS n FROM nodes_tags t
        JOIN (SELECT DISTINCT id FROM nodes_tags WHERE "value" = '{value}') i ON t.id = i.id
        WHERE t."key" = '{key}' GROUP BY t."value" """


def answers() -> str:
    def part(question: str, sql: str) -> str:
        return f"SELECT '{question}' AS question, \"value\", n FROM ({sql})"

    def counts(tags: str, condition: str, limit: str = "") -> str:
        end = f'ORDER BY n DESC, "value" {limit}' if limit else ""
        return f'SELECT "value", count(*) AS n FROM {tags} WHERE {condition} GROUP BY "value" {end}'

    def having(value: str, key: str) -> str:
        return (f'SELECT t."value", count(*) AS n FROM nodes_tags t JOIN (SELECT DISTINCT id FROM nodes_tags'
                f" WHERE \"value\" = '{value}') i ON t.id = i.id WHERE t.\"key\" = '{key}' GROUP BY t.\"value\"")

    users = 'SELECT "user" FROM nodes UNION ALL SELECT "user" FROM ways'
    parts = [
        part("top_postcodes", counts("tags", "\"key\" = 'postcode'")),
        part("top_phones", counts("tags", "\"key\" = 'phone'")),
        part("top_cities", counts("tags", "\"key\" ILIKE '%city'")),
        part("count_nodes", 'SELECT CAST(NULL AS VARCHAR) AS "value", count(*) AS n FROM nodes'),
        part("count_ways", 'SELECT CAST(NULL AS VARCHAR) AS "value", count(*) AS n FROM ways'),
        part("top_users", f'SELECT "user" AS "value", count(*) AS n FROM ({users}) GROUP BY 1'
                          ' ORDER BY n DESC, 1 LIMIT 10'),
        part("one_time_users", f'SELECT CAST(NULL AS VARCHAR) AS "value", count(*) AS n FROM (SELECT "user"'
                               f' FROM ({users}) GROUP BY 1 HAVING count(*) = 1)'),
        part("top_amenities", counts("nodes_tags", "\"key\" = 'amenity'", "LIMIT 10")),
        part("religions", having("place_of_worship", "religion")),
        part("cuisines", having("restaurant", "cuisine")),
    ]
    return f"WITH {NODES}, {WAYS}, {TAGS} " + " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    node_tags = f'WITH {TAGS} SELECT id, "key", "value", "type" FROM nodes_tags'
    way_tags = f'WITH {TAGS} SELECT id, "key", "value", "type" FROM ways_tags'
    return {
        "scan_elements": f"WITH {ELEMENTS} SELECT * FROM elements",
        "scan_top_level": f"""WITH {RAW_TAGS}, {TOP_LEVEL},
            tag_counts AS (SELECT elem AS name, id, count(*) AS n FROM raw_tags GROUP BY ALL),
            nd_counts AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY ALL)
            SELECT element, t.name, CAST(t.id AS VARCHAR) AS id,
                   CASE WHEN t.name = 'relation' THEN 1 ELSE coalesce(g.n, 0) END AS n_tag,
                   coalesce(r.n, 0) AS n_nd,
                   CAST(CASE WHEN t.name = 'relation' THEN 2 ELSE 0 END AS BIGINT) AS n_member
            FROM tops t LEFT JOIN tag_counts g ON t.name = g.name AND t.id = g.id
                        LEFT JOIN nd_counts r ON t.name = 'way' AND t.id = r.id""",
        "scan_commented": f"""WITH {RAW_TAGS}, {TOP_LEVEL},
            tag_counts AS (SELECT elem AS name, id, count(*) AS n FROM raw_tags GROUP BY ALL),
            nd_counts AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY ALL)
            SELECT element, t.name, CAST(t.id AS VARCHAR) AS id,
                   CASE WHEN t.name = 'relation' THEN 1 ELSE coalesce(g.n, 0) END AS n_tag,
                   coalesce(r.n, 0) AS n_nd,
                   CAST(CASE WHEN t.name = 'relation' THEN 2 ELSE 0 END AS BIGINT) AS n_member
            FROM tops t LEFT JOIN tag_counts g ON t.name = g.name AND t.id = g.id
                        LEFT JOIN nd_counts r ON t.name = 'way' AND t.id = r.id""",
        "csv_roundtrip": f"""WITH {NODES}, {WAYS}, {WAYS_NODES}, {TAGS},
            hard AS (
              SELECT 'nodes_tags' AS source, * FROM nodes_tags
              UNION ALL SELECT 'ways_tags', * FROM ways_tags)
            SELECT source, id, "key",
                   CASE WHEN id % 5 <> 0 THEN 'a' || chr(10) || '"b", ' || chr(13) || chr(10) || "value" END AS "value",
                   "type" FROM hard
            UNION ALL SELECT 'nodes', id, 'user', "user", "timestamp" FROM nodes
            UNION ALL SELECT 'ways', id, 'user', "user", "timestamp" FROM ways
            UNION ALL SELECT 'ways_nodes', id, 'position', CAST(node_id AS VARCHAR), CAST("position" AS VARCHAR)
            FROM ways_nodes""",
        "csv_roundtrip_nodes": f"WITH {NODES} SELECT * FROM nodes",
        "load_tables": f"""WITH {NODES}, {WAYS}, {WAYS_NODES}, {TAGS}
            SELECT 'nodes' AS table_name, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM nodes
            UNION ALL SELECT 'nodes_tags', count(*), CAST(sum(id) AS BIGINT) FROM nodes_tags
            UNION ALL SELECT 'ways', count(*), CAST(sum(id) AS BIGINT) FROM ways
            UNION ALL SELECT 'ways_nodes', count(*), CAST(sum(id) AS BIGINT) FROM ways_nodes
            UNION ALL SELECT 'ways_tags', count(*), CAST(sum(id) AS BIGINT) FROM ways_tags""",
        "sampled_extract": f"""WITH {RAW_TAGS}, {WAYS_NODES}, {TOP_LEVEL},
            sampled AS (SELECT name, id FROM tops WHERE element % 10 = 0)
            SELECT name AS parent_name, s.id AS parent_id, 'tag' AS name, k, v,
                   NULL AS ref, NULL AS "position"
            FROM sampled s JOIN raw_tags t ON s.name = t.elem AND s.id = t.id
            UNION ALL SELECT s.name, s.id, 'nd', NULL, NULL, CAST(node_id AS VARCHAR), "position"
            FROM sampled s JOIN ways_nodes w ON s.name = 'way' AND s.id = w.id
            UNION ALL SELECT s.name, s.id, 'tag', 'type', c_mktsegment, NULL, NULL
            FROM sampled s JOIN customer ON s.name = 'relation' AND s.id = c_custkey
            UNION ALL SELECT s.name, s.id, 'member', NULL, NULL, CAST(c_nationkey AS VARCHAR), NULL
            FROM sampled s JOIN customer ON s.name = 'relation' AND s.id = c_custkey
            UNION ALL SELECT s.name, s.id, 'member', NULL, NULL, CAST(c_custkey AS VARCHAR), NULL
            FROM sampled s JOIN customer ON s.name = 'relation' AND s.id = c_custkey""",
        "shape_nodes": f"WITH {NODES} SELECT * FROM nodes",
        "shape_ways": f"WITH {WAYS} SELECT * FROM ways",
        "shape_node_tags": node_tags,
        "shape_way_tags": way_tags,
        "markup_node_tags": node_tags,
        "markup_way_tags": way_tags,
        "split_key": f"""WITH {RAW_KEYS}
            SELECT DISTINCT k, {TYPE} AS "type", {KEY} AS "key" FROM raw_keys""",
        "way_node_positions": f'WITH {WAYS_NODES} SELECT id, node_id, "position" FROM ways_nodes',
        "tag_predicates": f"""WITH {RAW_TAGS}
            SELECT elem, k, count(*) FILTER (k = 'addr:street') AS street,
                   count(*) FILTER (k LIKE '%zip%') AS zip,
                   count(*) FILTER (k LIKE '%phone%') AS phone,
                   count(*) FILTER {LOCAL_PHONE} AS local_phone,
                   count(*) FILTER (k = 'addr:postcode' AND v LIKE '300%') AS audited_postcode,
                   count(*) FILTER (regexp_matches(k, '{PROBLEM}')) AS problem
            FROM raw_tags GROUP BY elem, k""",
        "validate_rows": f"""WITH {NODES}, {DIRTY}
            SELECT CAST(id AS BIGINT) AS id, lat, lon, "user", uid, version, changeset, "timestamp"
            FROM checked WHERE bad_id IS NULL AND bad_user IS NULL""",
        "quarantine_rows": f"""WITH {NODES}, {DIRTY}
            SELECT id, "user", concat_ws(',', bad_id, bad_user) AS errors
            FROM checked WHERE bad_id IS NOT NULL OR bad_user IS NOT NULL""",
        "quarantine_counts": f"""WITH {NODES}, {DIRTY}
            SELECT error, count(*) AS n FROM (
              SELECT bad_id AS error FROM checked UNION ALL SELECT bad_user FROM checked)
            WHERE error IS NOT NULL GROUP BY error""",
        "validated_elements": validated("kept, rejected, orphans"),
        "record_errors": """
            SELECT 'ways.user' AS path, 'required' AS error, count(*) AS n FROM orders WHERE o_orderkey % 101 = 0 HAVING count(*) > 0
            UNION ALL SELECT 'ways.changeset', 'type', count(*) FROM orders WHERE o_orderkey % 103 = 0 HAVING count(*) > 0
            UNION ALL SELECT 'ways_nodes[].node_id', 'type', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey % 109 = 0 HAVING count(*) > 0
            UNION ALL SELECT 'ways_tags[].type', 'required', count(*) FROM orders WHERE o_orderkey % 107 = 0 HAVING count(*) > 0""",
        "element_report": """WITH wrong AS (
              SELECT p_partkey * 2 AS element, unnest([
                  CASE WHEN p_partkey % 97 = 0 THEN 'nodes.id: type' END, CASE WHEN p_partkey % 89 = 0 THEN 'nodes.user: required' END,
                  CASE WHEN p_partkey % 83 = 0 THEN 'nodes.lat: type' END,
                  CASE WHEN p_partkey % 79 = 0 THEN 'nodes_tags[name].value: required' END]) AS line FROM part
              UNION ALL SELECT o_orderkey * 2 + 1, unnest([
                  CASE WHEN o_orderkey % 101 = 0 THEN 'ways.user: required' END, CASE WHEN o_orderkey % 103 = 0 THEN 'ways.changeset: type' END,
                  CASE WHEN o_orderkey % 109 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'ways_nodes[0].node_id: type' END,
                  CASE WHEN o_orderkey % 107 = 0 THEN 'ways_tags[Status].type: required' END]) FROM orders)
            SELECT element, string_agg(line, ', ' ORDER BY line) AS report FROM wrong WHERE line IS NOT NULL GROUP BY element""",
        "unvalidated_elements": validated("kept + rejected AS n"),
        "phone_format": f"""WITH {RAW_TAGS},
            phones AS (
              SELECT unnest(regexp_extract_all(text, '{PHONES}')) AS phone FROM documents
              UNION SELECT v FROM raw_tags WHERE lower(k) LIKE '%phone%')
            SELECT phone, {phone('phone')} AS formatted FROM phones""",
        "update_name": f"SELECT p_partkey, p_name, {replaced('p_name', NAME_MAPPING)} AS better_name FROM part",
        "clean_phone": f"""WITH {RAW_TAGS}
            SELECT elem, id, {replaced('v', PHONE_MAPPING)} AS phone FROM raw_tags WHERE k LIKE '%phone%'""",
        "count_tags": f"WITH {ELEMENTS} SELECT name, count(*) AS n FROM elements GROUP BY name",
        "count_tags_pages": """SELECT name, count(*) AS n FROM (
            SELECT unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9:._-]*)', 1)) AS name FROM pages)
            GROUP BY name""",
        "key_classes": f"""WITH {RAW_KEYS},
            classed AS (
              SELECT CASE WHEN regexp_matches(k, '^[a-z_]*$') THEN 'lower'
                          WHEN regexp_matches(k, '^[a-z_]*:[a-z_]*$') THEN 'lower_colon'
                          WHEN regexp_matches(k, '{PROBLEM}') THEN 'problemchars'
                          ELSE 'other' END AS key_class FROM raw_keys)
            SELECT c.key_class, count(classed.key_class) AS n
            FROM (VALUES ('lower'), ('lower_colon'), ('problemchars'), ('other')) c(key_class)
            LEFT JOIN classed USING (key_class) GROUP BY c.key_class""",
        "all_profiles": f"""WITH {ELEMENTS}
            SELECT 'count_tags' AS profile, name AS "value", NULL AS more, count(*) AS n FROM elements GROUP BY name
            UNION ALL SELECT 'key_classes', c.key_class, NULL, count(t.k)
              FROM (VALUES ('lower'), ('lower_colon'), ('problemchars'), ('other')) c(key_class)
              LEFT JOIN (SELECT k, CASE WHEN regexp_matches(k, '^[a-z_]*$') THEN 'lower'
                                        WHEN regexp_matches(k, '^[a-z_]*:[a-z_]*$') THEN 'lower_colon'
                                        WHEN regexp_matches(k, '{PROBLEM}') THEN 'problemchars'
                                        ELSE 'other' END AS key_class FROM elements WHERE name = 'tag') t USING (key_class)
              GROUP BY c.key_class
            UNION ALL SELECT DISTINCT 'distinct_users', uid, NULL, NULL::BIGINT FROM elements WHERE uid IS NOT NULL
            UNION ALL SELECT DISTINCT 'audit_street_types', regexp_extract(v, '[A-Za-z0-9_]\\S*$'), v, NULL::BIGINT FROM raw_tags
              WHERE k = 'addr:street' AND regexp_extract(v, '[A-Za-z0-9_]\\S*$') <> ''
                AND regexp_extract(v, '[A-Za-z0-9_]\\S*$') NOT IN ({EXPECTED})
            UNION ALL SELECT DISTINCT 'audit_zipcodes', v, NULL, NULL::BIGINT FROM raw_tags WHERE k = 'addr:postcode' AND v LIKE '300%'
            UNION ALL SELECT DISTINCT 'audit_phone', v, {phone('v')}, NULL::BIGINT FROM raw_tags WHERE {LOCAL_PHONE}""",
        "distinct_users": f"WITH {MARKUP_USERS} SELECT uid FROM users",
        "count_users": f"WITH {MARKUP_USERS} SELECT count(*) AS n FROM users",
        "audit_street_types": f"""WITH {RAW_TAGS},
            streets AS (
              SELECT regexp_extract(v, '[A-Za-z0-9_]\\S*$') AS street_type, v AS street_name
              FROM raw_tags WHERE k = 'addr:street')
            SELECT DISTINCT street_type, street_name FROM streets
            WHERE street_type <> '' AND street_type NOT IN ({EXPECTED})""",
        "audit_zipcodes": f"""WITH {RAW_TAGS}
            SELECT DISTINCT v AS postcode FROM raw_tags WHERE k = 'addr:postcode' AND v LIKE '300%'""",
        "audit_phone": f"""WITH {RAW_TAGS}
            SELECT DISTINCT v AS phone, {phone('v')} AS formatted FROM raw_tags WHERE {LOCAL_PHONE}""",
        "top_postcodes": value_counts("tags", "\"key\" = 'postcode'"),
        "top_phones": value_counts("tags", "\"key\" = 'phone'"),
        "top_cities": value_counts("tags", "\"key\" ILIKE '%city'"),
        "count_nodes": "SELECT count(*) AS n FROM part",
        "count_ways": "SELECT count(*) AS n FROM orders",
        "top_users": f"""WITH {CONTRIBUTIONS}
            SELECT "user", count(*) AS n FROM contributions GROUP BY "user"
            ORDER BY n DESC, "user" LIMIT 10""",
        "one_time_users": f"""WITH {CONTRIBUTIONS}
            SELECT count(*) AS n FROM (SELECT "user" FROM contributions GROUP BY "user" HAVING count(*) = 1)""",
        "top_amenities": value_counts("nodes_tags", "\"key\" = 'amenity'", "LIMIT 10"),
        "value_counts_religion": value_counts_for("PROMO", "name"),
        "value_counts_cuisine": value_counts_for("ECONOMY", "city"),
        "union_tags": f'WITH {TAGS} SELECT id, "key", "value", "type" FROM tags',
        "distinct_tagged_ids": f"WITH {TAGS} SELECT DISTINCT id FROM nodes_tags WHERE \"value\" = 'PROMO'",
        "every_kth": f"WITH {TOP_LEVEL} SELECT name, id, element FROM tops WHERE element % 10 = 0",
        "semi_join_tags": f"""WITH {TAGS}
            SELECT id, "key", "value", "type" FROM nodes_tags
            WHERE id IN (SELECT id FROM nodes_tags WHERE "value" = 'PROMO')""",
        "key_suffix": f"WITH {TAGS} SELECT id, \"key\", \"value\", \"type\" FROM tags WHERE \"key\" ILIKE '%city'",
        "whole_chain": answers(),
    }
