"""The derivation of ``plans/adapter.py`` and shared steps as SQL text for the check tool."""

from __future__ import annotations

# First and last address of the reserved blocks, written out apart from the operator's list.
RESERVED_RANGES = (
    (0, 16777215),  # 0.0.0.0/8
    (167772160, 184549375),  # 10.0.0.0/8
    (1681915904, 1686110207),  # 100.64.0.0/10
    (2130706432, 2147483647),  # 127.0.0.0/8
    (2851995648, 2852061183),  # 169.254.0.0/16
    (2886729728, 2887778303),  # 172.16.0.0/12
    (3221225472, 3221225727),  # 192.0.0.0/24
    (3221225984, 3221226239),  # 192.0.2.0/24
    (3227017984, 3227018239),  # 192.88.99.0/24
    (3232235520, 3232301055),  # 192.168.0.0/16
    (3323068416, 3323199487),  # 198.18.0.0/15
    (3325256704, 3325256959),  # 198.51.100.0/24
    (3405803776, 3405804031),  # 203.0.113.0/24
    (3758096384, 4294967295),  # 224.0.0.0/4 and 240.0.0.0/4
)


def reserved(ip: str) -> str:
    """SQL predicate: address in a reserved block."""
    return "(" + " OR ".join(f"{ip} BETWEEN {lo} AND {hi}" for lo, hi in RESERVED_RANGES) + ")"


def dotted(ip: str) -> str:
    """SQL text: uint32 as dotted quad."""
    parts = [f"CAST(({ip} >> {s}) & 255 AS VARCHAR)" for s in (24, 16, 8, 0)]
    return "(" + " || '.' || ".join(parts) + ")"


COMMON = f"""
obs_raw AS (
SELECT (l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey % 1048576 AS seq, 'd' || CAST(k AS VARCHAR) || '.example' AS domain, k, nat, r,
       (l_orderkey * 2654435761 + l_linenumber) % 4294967296 AS resolver_ip,
       CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE 100 + nat * 2 + c_custkey % 2 END AS resolver_asn,
       CASE WHEN nat = 5 AND k % 4 = 0 AND r < 70 THEN NULL
            WHEN r < 3 THEN NULL
            WHEN nat = 3 AND k % 2 = 0 AND r < 80 THEN 168436258
            WHEN nat = 11 AND k % 3 = 0 AND r < 80 THEN 1007353857
            WHEN r >= 97 THEN 1174405120 + nat * 65536 + k
            WHEN k % 4 = 0 THEN 335544320 + k * 65536 + 10
            WHEN k % 4 = 1 THEN 503316480 + k * 65536 + (r % 8) * 256 + r % 16
            WHEN k % 4 = 2 THEN 671088640 + (k % 3) * 65536 + (r % 4) * 256 + 1
            ELSE 838860800 + (r % 5) * 16777216 + k * 65536 + r % 7 END AS answer_ip
FROM (SELECT l_orderkey, l_linenumber, l_partkey, c_custkey, CAST(c_nationkey AS BIGINT) AS nat,
             CAST(substring(p_brand, 7) AS BIGINT) AS k,
             (l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7) % 100 AS r
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey) t
),
observations AS (
SELECT domain, resolver_asn, answer_ip, count(*) AS n FROM obs_raw GROUP BY domain, resolver_asn, answer_ip
),
prefixes AS (
SELECT DISTINCT answer_ip - answer_ip % 65536 AS network, 16 AS prefix_len, 1000 + (answer_ip >> 16) AS asn
FROM observations WHERE answer_ip >= 184549376
UNION ALL
SELECT DISTINCT answer_ip - answer_ip % 256, 24, 100000 + (answer_ip >> 16)
FROM observations WHERE answer_ip >= 184549376 AND (answer_ip >> 8) % 7 = 3
),
asn_country AS (
SELECT asn, 'NATION_' || CAST(CASE WHEN asn < 1000 THEN CAST(floor((asn - 100) / 2.0) AS BIGINT)
                 WHEN asn IN (16371, 115371) THEN 11 ELSE asn % 25 END AS VARCHAR) AS country
FROM (SELECT DISTINCT asn FROM prefixes
      UNION SELECT DISTINCT resolver_asn FROM observations WHERE resolver_asn IS NOT NULL) a
),
hosts AS (
SELECT DISTINCT answer_ip AS ip, (answer_ip >> 16) % 256 AS site FROM observations WHERE answer_ip >= 184549376
),
ptrs AS (
SELECT ip, CASE WHEN ip % 11 = 0 THEN NULL ELSE 'host' || (ip % 256) || '.cdn' || site ||
           CASE WHEN ip % 2 = 0 THEN '.net' ELSE '.co.uk' END END AS name FROM hosts
),
servers AS (
SELECT ip, CASE WHEN ip % 13 = 0 THEN 504 ELSE 200 END AS status,
       CASE WHEN ip % 13 = 0 THEN '' ELSE 'edge/' || site END AS server FROM hosts
),
ptr_label AS (
SELECT ip, name, CASE WHEN name IS NULL OR name = '' OR name LIKE '.%' THEN NULL
       WHEN len(p) > 3 AND length(p[-2]) < 3 THEN p[-3] ELSE p[-2] END AS ptr
FROM (SELECT ip, name, string_split(name, '.') AS p FROM ptrs) t
),
lpm AS (
SELECT ip, arg_max(asn, prefix_len) AS asn
FROM (SELECT DISTINCT answer_ip AS ip FROM observations WHERE answer_ip IS NOT NULL) i
JOIN prefixes ON ip - ip % CAST(pow(2, 32 - prefix_len) AS BIGINT) = network AND prefix_len BETWEEN 9 AND 24
GROUP BY ip
),
country1 AS (SELECT asn, max(country) AS country FROM asn_country GROUP BY asn),
whois_text AS (
SELECT ip, 'inetnum: 1' || chr(10) || CASE WHEN ip % 7 <> 0 THEN 'netname:  NET-' || (ip >> 16) || chr(10) ELSE '' END
       || CASE WHEN ip % 3 = 0 THEN 'OrgNOCName: NOC ' || (ip % 10) || chr(10) ELSE '' END || 'country: X' AS text
FROM hosts
),
whois AS (
SELECT ip, CASE WHEN ip % 3 = 0 THEN 'NOC ' || (ip % 10) WHEN ip % 7 <> 0 THEN 'NET-' || (ip >> 16) END AS org FROM hosts
),
ip_domain AS (
SELECT answer_ip AS ip, domain, CAST(sum(n) AS BIGINT) AS n FROM observations
WHERE resolver_asn IS NOT NULL AND answer_ip IS NOT NULL GROUP BY answer_ip, domain
),
net_domain AS (
SELECT ip - ip % 256 AS net, domain, CAST(sum(n) AS BIGINT) AS n FROM ip_domain GROUP BY 1, 2
),
domain_keys AS (SELECT DISTINCT domain, k FROM obs_raw),
clusters AS (SELECT domain, CAST(CASE WHEN k % 4 = 2 THEN k % 3 ELSE 100 + k END AS INTEGER) AS cluster_id FROM domain_keys),
shard_pos AS (
SELECT domain, CAST(floor((row_number() OVER (ORDER BY k) - 1) / 10) AS BIGINT) AS s,
       CAST((row_number() OVER (ORDER BY k) - 1) % 10 AS INTEGER) AS idx FROM domain_keys
),
shards AS (
SELECT md5(names) AS shard, idx, domain FROM shard_pos
JOIN (SELECT s, string_agg(domain, ',' ORDER BY idx) AS names FROM shard_pos GROUP BY s) g USING (s)
),
resolvers AS (SELECT DISTINCT resolver_ip AS ip FROM obs_raw),
resolver_prefixes AS (
SELECT network, 12 AS prefix_len, 100 + block % 50 AS asn
FROM (SELECT DISTINCT resolver_ip - resolver_ip % 1048576 AS network, resolver_ip >> 20 AS block FROM obs_raw) t
WHERE block % 3 <> 0
),
resolver_asn AS (
SELECT ip, p.asn FROM resolvers LEFT JOIN resolver_prefixes p ON ip - ip % 1048576 = network
),
responses AS (
SELECT seq, domain, r, resolver_ip, resolver_asn, r NOT IN (5, 6, 8) AS ok, r IN (6, 8) AS headless,
       CASE WHEN r = 9 THEN 0 ELSE 1 END AS qr, CASE WHEN r = 7 THEN 0 ELSE 1 END AS ra,
       CASE WHEN answer_ip IS NULL THEN 3 ELSE 0 END AS rcode,
       CASE WHEN answer_ip IS NULL THEN 0 ELSE 1 + CAST(r % 10 = 4 AS INTEGER) + CAST(k % 4 = 1 AS INTEGER) END AS ancount,
       CASE WHEN r = 42 THEN 'd0.example' WHEN r = 43 THEN 'd' || (k - k % 10 + 1) || '.example' ELSE domain END AS qname,
       CASE WHEN answer_ip IS NULL THEN CAST([] AS BIGINT[]) WHEN r % 10 = 4 THEN [answer_ip, answer_ip + 1]
            ELSE [answer_ip] END AS a_records,
       CASE WHEN k % 4 <> 1 THEN answer_ip END AS first_a
FROM obs_raw
),
favicons AS (
SELECT ip, host, status, length, CASE WHEN status = 200 THEN md5(CASE WHEN ip % 5 = 0 THEN 'x' || host ELSE host END) ELSE '' END AS hash, 'image/x-icon' AS ctype, seq
FROM (SELECT DISTINCT answer_ip AS ip, domain AS host, k AS seq, 1000 + k AS length,
             CASE WHEN (answer_ip + k) % 17 = 0 THEN CAST(-1 - answer_ip % 5 AS INTEGER) WHEN (answer_ip + k) % 19 = 0 THEN 404 ELSE 200 END AS status
      FROM obs_raw WHERE answer_ip IS NOT NULL) t
),
favicon_fetches AS (
SELECT domain AS host, CASE WHEN k % 7 = 0 THEN 404 ELSE 200 END AS status, md5(domain) AS hash, k AS seq FROM domain_keys
),
http_pairs AS (SELECT DISTINCT answer_ip AS ip, domain FROM observations WHERE answer_ip IS NOT NULL),
http_scans AS (
SELECT 80 AS port, 'tcp_synscan' AS mode, ip FROM http_pairs WHERE ip % 3 <> 0
UNION ALL SELECT 80, 'tcp_ackscan', ip FROM http_pairs WHERE ip % 4 <> 0
UNION ALL SELECT 443, 'tcp_synscan', ip FROM http_pairs WHERE ip % 5 <> 0
UNION ALL SELECT 443, 'tcp_ackscan', ip FROM http_pairs WHERE ip % 7 <> 1
),
redirects AS (
SELECT domain, CASE WHEN k % 3 <> 0 THEN 301 ELSE 200 END AS status,
       'd' || (k - k % 10 + (k % 10) % 5 + 1) || '.example' AS host FROM domain_keys
),
by_country AS (
SELECT c.country, o.* FROM observations o JOIN (SELECT DISTINCT * FROM asn_country) c ON o.resolver_asn = c.asn
),
cells AS MATERIALIZED (SELECT * FROM net_domain),
norms AS MATERIALIZED (SELECT domain, sqrt(sum(CAST(n AS DOUBLE) * n)) AS norm FROM cells GROUP BY domain),
weights0 AS MATERIALIZED (SELECT domain, net, CASE WHEN {reserved('net')} THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS w FROM cells),
"""


def _round(i: int) -> str:
    """Similarity after ``i`` reweightings and the weights derived from it."""
    return f"""
sim{i} AS MATERIALIZED (
SELECT a, b, least(1.0::DOUBLE, dot / (x.norm * y.norm)) AS sim
FROM (SELECT p.domain AS a, q.domain AS b, sum(p.n * (1 + v.w) * (q.n * (1 + u.w))) AS dot
      FROM cells p JOIN weights{i} v ON p.domain = v.domain AND p.net = v.net
      JOIN cells q ON p.net = q.net AND p.domain < q.domain
      JOIN weights{i} u ON q.domain = u.domain AND q.net = u.net
      WHERE v.w > -1 AND u.w > -1 GROUP BY 1, 2) d
JOIN norms x ON x.domain = a JOIN norms y ON y.domain = b
),
full{i} AS MATERIALIZED (SELECT a, b, sim FROM sim{i} UNION ALL SELECT b, a, sim FROM sim{i}),
weights{i + 1} AS MATERIALIZED (
SELECT p.domain, p.net, CASE WHEN {reserved('p.net')} THEN -1.0::DOUBLE WHEN count(q.domain) = 0 THEN 0.0::DOUBLE
       ELSE 2 * sum(q.n * coalesce(s.sim, 0)) / sum(q.n) - 1 END AS w
FROM cells p LEFT JOIN cells q ON p.net = q.net AND p.domain <> q.domain
LEFT JOIN full{i} s ON s.a = p.domain AND s.b = q.domain
GROUP BY p.domain, p.net
),"""


def scores_cte() -> str:
    return f"""
scores AS MATERIALIZED (
SELECT p.domain, p.ip, sum(q.n * CASE WHEN p.domain = q.domain THEN 1.0::DOUBLE ELSE coalesce(s.sim, 0) END) / sum(q.n) * max(p.n) AS score
FROM ip_domain p JOIN ip_domain q ON p.ip = q.ip LEFT JOIN full0 s ON s.a = p.domain AND s.b = q.domain
WHERE NOT {reserved('p.ip')} GROUP BY p.domain, p.ip
),
footprint AS (
SELECT cluster_id, net FROM net_domain JOIN clusters USING (domain)
JOIN (SELECT cluster_id, count(*) AS size FROM clusters GROUP BY 1) z USING (cluster_id)
GROUP BY cluster_id, net, size HAVING 2 * count(*) FILTER (n > 50) > size
),
net_meta AS (
SELECT ip - ip % 256 AS net, arg_max(name, ip) AS name FROM ptrs WHERE name IS NOT NULL GROUP BY 1
),
cluster_tags AS (
SELECT cluster_id, tag, n / size AS confidence FROM (
  SELECT cluster_id, tag, count(*) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, tag) AS rn
  FROM footprint JOIN (SELECT net, lower(trim(name)) AS t0, string_split(lower(trim(name)), '.') AS p FROM net_meta) m USING (net),
  LATERAL (SELECT CASE WHEN NOT contains(t0, ' ') AND len(p) > 2 AND length(p[1]) > 5 THEN array_to_string(p[2:], '.') ELSE t0 END AS tag) l
  GROUP BY 1, 2) t
JOIN (SELECT cluster_id, count(*) AS size FROM footprint GROUP BY 1) z USING (cluster_id) WHERE rn = 1
),
sig_ip AS (SELECT domain, answer_ip AS ip, CAST(sum(n) AS BIGINT) AS n FROM observations WHERE resolver_asn <> 0 GROUP BY 1, 2),
sig_total AS (SELECT domain, CAST(sum(n) AS BIGINT) AS total FROM sig_ip GROUP BY 1),
sig_rank AS (
SELECT domain, ip, n, total, row_number() OVER w AS rn, sum(n) OVER w AS cum, lead(n) OVER w AS nxt
FROM sig_ip JOIN sig_total USING (domain) WINDOW w AS (PARTITION BY domain ORDER BY n DESC, ip ASC NULLS FIRST)
),
sig_head AS (
SELECT s.domain, s.ip, s.n, s.rn FROM sig_rank s JOIN (
  SELECT domain, rn AS stop FROM sig_rank QUALIFY cum > 0.75::DOUBLE * total AND rn <= 4 AND (nxt IS NULL OR n >= 1.5::DOUBLE * nxt)
    AND rn = min(CASE WHEN cum > 0.75::DOUBLE * total THEN rn END) OVER (PARTITION BY domain)) h
ON s.domain = h.domain AND s.rn <= h.stop
),
sig_seen AS (
SELECT domain, 'ASN' AS method, CAST(asn AS VARCHAR) AS value, n FROM sig_ip JOIN lpm USING (ip)
UNION ALL SELECT domain, 'PTR', ptr, n FROM sig_ip JOIN ptr_label USING (ip) WHERE ptr IS NOT NULL
UNION ALL SELECT domain, 'SERVER', server, n FROM sig_ip JOIN servers USING (ip) WHERE status < 500 AND server <> ''
),
signatures AS MATERIALIZED (
SELECT domain, 'IP' AS method, list(coalesce({dotted('ip')}, 'empty') ORDER BY rn) AS value FROM sig_head GROUP BY domain
UNION ALL
SELECT domain, method, [value] FROM (SELECT domain, method, value, sum(n) AS n FROM sig_seen GROUP BY 1, 2, 3) t
JOIN sig_total USING (domain) WHERE n > 0.75::DOUBLE * total
),
c_ip AS MATERIALIZED (
SELECT country, domain, answer_ip AS ip, CAST(sum(n) AS BIGINT) AS n FROM by_country WHERE answer_ip IS NOT NULL GROUP BY 1, 2, 3
),
c_total AS (SELECT country, domain, CAST(sum(n) AS BIGINT) AS total FROM c_ip GROUP BY 1, 2),
c_seen AS (
SELECT country, domain, 'IP' AS method, {dotted('ip')} AS value, n FROM c_ip
UNION ALL SELECT country, domain, 'ASN', CAST(asn AS VARCHAR), n FROM c_ip LEFT JOIN lpm USING (ip)
UNION ALL SELECT country, domain, 'PTR', ptr, n FROM c_ip JOIN ptr_label USING (ip) WHERE ptr IS NOT NULL
UNION ALL SELECT country, domain, 'SERVER', server, n FROM c_ip JOIN servers USING (ip) WHERE status < 500 AND server <> ''
),
c_value AS (SELECT country, domain, method, value, CAST(sum(n) AS BIGINT) AS n FROM c_seen GROUP BY 1, 2, 3, 4),
c_check AS (
SELECT t.country, t.domain, t.total, s.method, s.value AS expected,
       CAST(coalesce(sum(v.n) FILTER (list_contains(s.value, v.value)), 0) AS BIGINT) AS good,
       first(v.value ORDER BY v.n DESC, v.value ASC NULLS FIRST) AS top, max(v.n) AS top_n
FROM c_total t JOIN signatures s USING (domain)
LEFT JOIN c_value v ON v.country = t.country AND v.domain = t.domain AND v.method = s.method
WHERE t.total > 20 GROUP BY 1, 2, 3, 4, 5
),
anomalies AS MATERIALIZED (
SELECT * FROM c_check QUALIFY max(good * 4 > total) OVER (PARTITION BY country, domain) = false
   AND max(method = 'IP' AND expected[1] = 'empty') OVER (PARTITION BY country, domain) = false
),
anomaly_pairs AS (SELECT DISTINCT country, domain FROM anomalies),
ubiquitous AS (
SELECT domain FROM anomaly_pairs GROUP BY domain
HAVING count(*) > (SELECT count(DISTINCT country) / 2 FROM anomaly_pairs)
),
world_ip AS (SELECT domain, answer_ip AS ip, CAST(sum(n) AS BIGINT) AS g FROM observations WHERE answer_ip IS NOT NULL GROUP BY 1, 2),
world_dom AS (SELECT domain, max(g) AS g_max, arg_max(ip, (g, -ip)) AS top_ip FROM world_ip GROUP BY 1),
candidates AS (
SELECT c.country, c.ip, c.domain FROM c_ip c JOIN c_total t USING (country, domain)
JOIN world_ip w ON w.domain = c.domain AND w.ip = c.ip JOIN world_dom d ON d.domain = c.domain
LEFT JOIN lpm ON lpm.ip = c.ip LEFT JOIN country1 h ON h.asn = lpm.asn
WHERE c.n * 10 >= t.total AND c.n * d.g_max > w.g * t.total
  AND NOT (NOT {reserved('c.ip')} AND h.country IS NOT NULL AND h.country <> c.country)
)"""


def hosted(sites: int) -> str:
    """Cells of many domains and their similarities; see ``Inputs.hosted``."""
    return f"""
hosted AS MATERIALIZED (
SELECT domain, CASE WHEN r >= 97 THEN 168436224
       ELSE 1207959552 + 256 * (CASE WHEN r < CASE WHEN h % 5 = 0 THEN 75 ELSE 25 END THEN 100000 + site % 40
                                     WHEN r < 90 THEN h // 3 ELSE 200000 + r % 2 END) END AS net, count(*) AS n
FROM (SELECT k * {sites} + site AS h, site, r, 'd' || k || 's' || site || '.example' AS domain
      FROM (SELECT k, r, seq % 1048576 % {sites} AS site FROM obs_raw) t) t GROUP BY ALL
),
hosted_norms AS (SELECT domain, sqrt(sum(CAST(n AS DOUBLE) * n)) AS norm FROM hosted GROUP BY 1),
hosted_sim AS MATERIALIZED (
SELECT a, b, dot / (x.norm * y.norm) AS sim
FROM (SELECT p.domain AS a, q.domain AS b, sum(CAST(p.n AS DOUBLE) * q.n) AS dot, count(*) AS shared
      FROM hosted p JOIN hosted q ON p.net = q.net AND p.domain < q.domain WHERE p.net <> 168436224 GROUP BY 1, 2) t
JOIN hosted_norms x ON x.domain = a JOIN hosted_norms y ON y.domain = b
)"""


def with_common(select: str, rounds: int = 0, extra: str = "") -> str:
    """A full statement: the shared steps, ``rounds`` similarity rounds, then ``select``."""
    steps = "".join(_round(i) for i in range(rounds + 1))
    tail = f",\n{extra}" if extra else ""
    return f"WITH RECURSIVE {COMMON.strip()}{steps}{scores_cte()}{tail}\n{select}"
