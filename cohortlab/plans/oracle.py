"""DuckDB SQL for the stand-in views, used to build the oracle text of each query.

Each view mirrors the Spark code of the same name one to one. ``with_views`` adds
the needed views (and their dependencies) as CTEs in front of a query.
"""
from __future__ import annotations

VIEWS: dict[str, tuple[list[str], str]] = {}


def _view(name: str, deps: list[str], sql: str) -> None:
    VIEWS[name] = (deps, sql)


_view("co_per_order", [], """
  SELECT l_orderkey,
         string_agg(p_type, '|' ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS category_list,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS usd,
         count(*) AS n_lines,
         min(l_shipdate) AS first_ship,
         max(l_shipdate) AS last_ship
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
  GROUP BY l_orderkey""")

_view("companies_raw", ["co_per_order"], """
  SELECT '/o/' || CAST(o_orderkey AS VARCHAR) AS permalink,
         CAST(o_orderkey AS VARCHAR) AS name,
         CAST(NULL AS VARCHAR) AS homepage_url,
         category_list,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' OR usd IS NULL THEN '-'
              ELSE CAST(usd * CASE o_orderkey % 5 WHEN 0 THEN 0.1 WHEN 1 THEN 1.0 WHEN 2 THEN 10.0
                                   WHEN 3 THEN 100.0 ELSE 1000.0 END AS VARCHAR) END AS funding_total_usd,
         CASE WHEN o_orderstatus = 'P' THEN 'operating'
              WHEN (o_orderstatus = 'O' AND o_orderkey % 5 >= 1)
                OR (o_orderstatus = 'F' AND (o_orderkey % 5 = 4 OR c_nationkey < 5))
                THEN CASE WHEN o_orderkey % 4 = 0 THEN 'ipo' ELSE 'acquired' END
              ELSE 'closed' END AS status,
         n_name AS country_code,
         CAST(NULL AS VARCHAR) AS state_code,
         r_name AS region,
         c_mktsegment AS city,
         CAST(coalesce(n_lines, 0) AS VARCHAR) AS funding_rounds,
         CASE WHEN o_orderkey % 4 = 1 THEN NULL
              WHEN o_orderkey % 97 = 0 THEN '1015-01-30'
              WHEN o_orderkey % 101 = 0 THEN '2914-01-01'
              ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS founded_at,
         CAST(CAST(coalesce(first_ship, o_orderdate) AS DATE) AS VARCHAR) AS first_funding_at,
         CAST(CAST(coalesce(last_ship, o_orderdate) AS DATE) AS VARCHAR) AS last_funding_at
  FROM orders
  LEFT JOIN co_per_order ON o_orderkey = l_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey""")

_view("co_labelled", ["companies_raw"], """
  SELECT *, CASE WHEN status IN ('acquired', 'ipo') THEN 1 WHEN status = 'closed' THEN 0 END AS label
  FROM companies_raw WHERE status IS DISTINCT FROM 'operating'""")

_view("co_dates", ["co_labelled"], """
  SELECT *, CAST(try_strptime(founded_at, '%Y-%m-%d') AS DATE) AS founded_raw,
         CAST(try_strptime(first_funding_at, '%Y-%m-%d') AS DATE) AS first_d,
         CAST(try_strptime(last_funding_at, '%Y-%m-%d') AS DATE) AS last_d
  FROM co_labelled""")

_view("co_eff", ["co_dates"], """
  SELECT *, coalesce(founded_clean, first_d) AS eff
  FROM (SELECT d.*, CASE WHEN d.founded_raw IS NOT NULL AND year(d.founded_raw) >= 1900
                          AND d.founded_raw <= u.upper_d THEN d.founded_raw END AS founded_clean
        FROM co_dates d CROSS JOIN (SELECT max(first_d) AS upper_d FROM co_dates) u) x""")

_view("co_boundary", ["co_eff"], """
  SELECT quantile_cont(date_diff('day', DATE '1970-01-01', eff), 0.8) AS boundary_days FROM co_eff""")

_view("features", ["co_eff", "co_boundary"], """
  SELECT CAST(year(eff) AS DOUBLE) AS founded_year,
         CAST(date_diff('day', founded_clean, first_d) AS DOUBLE) AS time_to_first_funding_days,
         country_code, region,
         split_part(category_list, '|', 1) AS primary_category,
         category_list,
         ln(1 + usd_num) AS funding_total_usd_log1p,
         CAST(funding_rounds AS DOUBLE) AS funding_rounds,
         CAST(date_diff('day', first_d, last_d) AS DOUBLE) AS funding_span_days,
         CAST(label AS INTEGER) AS label,
         permalink, name,
         usd_num AS funding_total_usd,
         CASE WHEN date_diff('day', DATE '1970-01-01', eff) <= boundary_days THEN 'train' ELSE 'test' END AS split,
         eff AS effective_date
  FROM (SELECT *, CASE WHEN trim(funding_total_usd) = '-' THEN NULL
                       ELSE CAST(replace(trim(funding_total_usd), ',', '') AS DOUBLE) END AS usd_num
        FROM co_eff) e
  CROSS JOIN co_boundary""")

_view("scores", [], """
  SELECT event_id AS key,
         CAST(event_type IN ('purchase', 'signup') AS INTEGER) AS label,
         CAST((event_id * 7919) % 1000 AS INTEGER) AS score_key,
         CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000.0 AS score
  FROM events""")


def _resolve(names: list[str], out: list[str]) -> None:
    for n in names:
        if n in out:
            continue
        deps, _ = VIEWS[n]
        _resolve(deps, out)
        if n not in out:
            out.append(n)


def add_view(name: str, deps: list[str], sql: str) -> None:
    _view(name, deps, sql)


def with_views(names: list[str], body: str) -> str:
    order: list[str] = []
    _resolve(names, order)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
