"""The same results as plain SQL over the given tables, for an independent engine."""

from bidmatrix.sources.taxonomy import OFFICIAL

_ITEMS = """
items as (
 select 'session_' || cast(c_nationkey as varchar) || '_' || cast(l_suppkey - l_suppkey % 5 as varchar) as session_id,
  'q' || cast(c_nationkey as varchar) || '_' || cast(l_suppkey as varchar) as quote_id,
  s_name as vendor_name, 'S' || cast(l_suppkey as varchar) || '.pdf' as source_filename,
  p_type as service_category, p_type || ' S' || cast(p_size % 4 as varchar) as sub_service,
  p_name as work_title, p_name || '&nbsp;size ' || cast(p_size as varchar) as description, p_size,
  l_quantity as quantity, case when p_size % 2 = 0 then 'Square Feet' else 'Unit' end as pricing_method,
  cast(round(l_extendedprice * 100 / l_quantity) as bigint) as rate_cents,
  cast(round(l_extendedprice * 100) as bigint) as amount_cents,
  cast(round(l_extendedprice * 100 * (1 - l_discount) * (1 + l_tax)) as bigint) as gross_cents,
  o_orderdate, l_linestatus, l_orderkey * 10 + l_linenumber as pos
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey)"""

_QUOTES = """
quotes as (
 select session_id, quote_id, vendor_name, source_filename,
  cast(sum(gross_cents) as bigint) as grand_total_cents, strftime(min(o_orderdate), '%Y-%m-%d') as quote_date
 from items group by session_id, quote_id, vendor_name, source_filename)"""

_CELLS = """
cells as (
 select session_id, service_category, sub_service, vendor_name || ' (' || source_filename || ')' as vendor,
  cast(sum(amount_cents) as bigint) as amount_cents
 from items group by all)"""

_BASE = """
base as (
 select session_id, service_category, sub_service, count(*) filter (where amount_cents > 0) as n_providers,
  cast(coalesce((2 * sum(amount_cents) filter (where amount_cents > 0) + count(*) filter (where amount_cents > 0))
   // (2 * nullif(count(*) filter (where amount_cents > 0), 0)), 0) as bigint) as baseline_cents
 from cells group by all)"""

_VENDORS = "vendors as (select distinct session_id, vendor from cells)"
_NV = "nv as (select session_id, count(*) as n_vendors from vendors group by all)"

_DENSE = """
dense as (
 select b.*, v.vendor, coalesce(c.amount_cents, 0) as amount_cents, c.vendor is not null as quoted
 from base b join vendors v using (session_id)
  left join cells c on c.session_id = b.session_id and c.service_category = b.service_category
   and c.sub_service = b.sub_service and c.vendor = v.vendor)"""

_TOTALS = """
totals as (
 select distinct session_id, vendor_name || ' (' || source_filename || ')' as vendor,
  grand_total_cents as total_cents from quotes)"""

_COUNTS = "counts as (select session_id, sub_service, count(*) as n from items group by all)"
_TOP = """
top as (select * from (select *, row_number() over (partition by session_id order by n desc, sub_service) as place
 from counts) where place <= 20)"""

_TAXONOMY = """
taxonomy as (
 select distinct service_category, sub_service from items where not ends_with(sub_service, 'S3')
 union all select 'ECONOMY', 'ECONOMY S9' union all select 'SPARE', 'SPARE S0')"""

_SCOPE = """
scoped as (
 select c.*, b.n_providers, b.baseline_cents, nv.n_vendors
 from cells c join base b using (session_id, service_category, sub_service) join nv using (session_id)),
per_session as (
 select session_id, sum(baseline_cents) as session_baseline, count(*) as n_services
 from base where n_providers > 0 group by all),
per_vendor as (
 select session_id, vendor, sum(amount_cents) as total_cents,
  coalesce(sum(amount_cents) filter (where n_providers = n_vendors), 0) as common_cents,
  count(*) filter (where n_providers = n_vendors) as n_common,
  coalesce(sum(amount_cents) filter (where n_providers >= 2), 0) as shared_cents,
  coalesce(sum(baseline_cents) filter (where n_providers >= 2), 0) as shared_baseline,
  count(*) filter (where n_providers >= 2) as n_shared, count(*) as n_provided, sum(baseline_cents) as own_baseline
 from scoped group by all)"""

_PAIRS = """
pairs as (
 select session_id, max(vendor) filter (where lo = 1) as vendor_a, max(vendor) filter (where hi = 1) as vendor_b
 from (select *, row_number() over (partition by session_id order by total_cents, vendor) as lo,
   row_number() over (partition by session_id order by total_cents desc, vendor) as hi from totals)
 group by session_id)"""


def _rupees(cents: str) -> str:
    return (
        f"'₹' || format('{{:,}}', {cents} // 100) || case when {cents} % 100 = 0 then ''"
        f" when {cents} % 10 = 0 then '.' || cast({cents} % 100 // 10 as varchar)"
        f" else '.' || lpad(cast({cents} % 100 as varchar), 2, '0') end"
    )


def _amount(cents: str) -> str:
    """Cents as text with two decimals."""
    return f"(cast({cents} // 100 as varchar) || '.' || lpad(cast({cents} % 100 as varchar), 2, '0'))"


def _pct(points: str) -> str:
    return f"cast(abs({points}) // 100 as varchar) || '.' || lpad(cast(abs({points}) % 100 as varchar), 2, '0') || '%'"


def _with(*parts: str) -> str:
    return "with " + ",\n".join(p.strip() for p in parts) + "\n"


_C = (_ITEMS, _CELLS)
_B = (*_C, _BASE)
_D = (*_B, _VENDORS, _DENSE)
_Q = (_ITEMS, _QUOTES)
_T = (*_Q, _TOTALS)
_S = (*_B, _VENDORS, _NV, _SCOPE)
_ROW = "session_id, service_category, sub_service"
_ITEM = (
    "session_id, service_category, sub_service, work_title, replace(description, '&nbsp;', ' ') as description, "
    "quantity, pricing_method, rate_cents, amount_cents"
)
_SENT_SESSION = (
    "case when grand_total_cents % 2 = 0 then 'session_' || sha256(quote_id) else session_id end"
)
_LABEL = "vendor_name || ' (' || source_filename || ')'"

_SUMMARY = """
scored as (
 select *, n_services - n_provided as n_missing,
  cast(sign(shared_cents - shared_baseline) * ((2 * abs(shared_cents - shared_baseline) * 10000 + shared_baseline)
   // (2 * nullif(shared_baseline, 0))) as bigint) as points
 from per_vendor join per_session using (session_id)),
ranked as (
 select *, row_number() over (partition by session_id order by points desc, vendor) as hi,
  row_number() over (partition by session_id order by points, vendor) as lo,
  row_number() over (partition by session_id order by n_missing desc, vendor) as gap from scored),
low as (select session_id, vendor, total_cents from
 (select *, row_number() over (partition by session_id order by total_cents, vendor) as r from totals) where r = 1),
summary as (
 select low.session_id, 'Lowest total: ' || low.vendor || ' at ' || """ + _rupees("low.total_cents") + """ || '.' || chr(10) ||
  case when coalesce(h.points, 0) <= 0 then 'No vendor is above the baseline on shared services'
   else 'Furthest above the baseline: ' || h.vendor || ' by ' || """ + _pct("h.points") + """ end || '.' || chr(10) ||
  case when coalesce(l.points, 0) >= 0 then 'No vendor is below the baseline on shared services'
   else 'Furthest below the baseline: ' || l.vendor || ' by ' || """ + _pct("l.points") + """ end || '.' || chr(10) ||
  case when g.n_missing = 0 then 'No vendor leaves out a service'
   else 'Most missing scope: ' || g.vendor || ' without ' || cast(g.n_missing as varchar) || ' of '
    || cast(g.n_services as varchar) || ' services' end || '.' as summary
 from low join ranked h on h.session_id = low.session_id and h.hi = 1
  join ranked l on l.session_id = low.session_id and l.lo = 1
  join ranked g on g.session_id = low.session_id and g.gap = 1)"""

_SECTIONS = """
table_rows as (
 select session_id, null::bigint as sort_number, service_category || chr(31) || sub_service || chr(31) || vendor as sort_text,
  '{"category":"' || service_category || '","sub_service":"' || sub_service || '","market_average":' || """ + _amount("baseline_cents") + """
  || ',"vendor":"' || vendor || '","amount":' || """ + _amount("amount_cents") + """ || '}' as entry from dense),
chart_rows as (
 select session_id, total_cents as sort_number, vendor as sort_text,
  '{"vendor":"' || vendor || '","total":' || """ + _amount("total_cents") + """ || '}' as entry from totals)"""

_CHAT = """
rates as (select session_id, sub_service, """ + _LABEL + """ as vendor,
  cast((2 * sum(rate_cents) + count(*)) // (2 * count(*)) as bigint) as r from items
  semi join top using (session_id, sub_service) group by all),
specs as (select distinct session_id, sub_service, """ + _LABEL + """ as vendor, description from items
  semi join top using (session_id, sub_service)),
context as (
 select session_id, 'vendor_totals' as section, total_cents as sort_number, vendor as sort_text,
  '{"vendor":"' || vendor || '","grand_total":' || """ + _amount("total_cents") + """ || '}' as entry from totals
 union all select session_id, 'item_rates', null, sub_service || chr(31) || vendor,
  '{"sub_service":"' || sub_service || '","vendor":"' || vendor || '","rate":' || """ + _amount("r") + """ || '}' from rates
 union all select session_id, 'item_specs', null, sub_service || chr(31) || vendor || chr(31) || description,
  '{"sub_service":"' || sub_service || '","vendor":"' || vendor || '","description":"' || description || '"}' from specs)"""

_SENT = f"""
sent as (select *, {_SENT_SESSION} as sent_session from quotes)"""

_BARE = """
bare as (select 'bare_' || cast(s_suppkey as varchar) as session_id, 'bare_q' || cast(s_suppkey as varchar) as quote_id,
  s_name as vendor_name, cast(0 as bigint) as grand_total_cents from supplier),
all_quotes as (select session_id, quote_id, vendor_name, grand_total_cents from quotes union all from bare)"""

_STATUS = """
lines as (select session_id, quote_id, count(*) as n from items group by all),
per as (select q.session_id, count(*) as n_quotes, coalesce(sum(l.n), 0) as n_items
 from all_quotes q left join lines l using (session_id, quote_id) group by all),
asked as (select distinct session_id from all_quotes union all select 'empty_' || cast(n_nationkey as varchar) from nation)"""

_USED = "used as (select service_category, sub_service, count(*) as n_items from items group by all)"

_UNCOVERED = """
uncovered as (
 select s.session_id, t.service_category, t.sub_service from (select distinct session_id from cells) s, taxonomy t
 where not exists (select 1 from cells c where c.session_id = s.session_id
  and c.service_category = t.service_category and c.sub_service = t.sub_service))"""

ORACLES: dict[str, str] = {
    "q_cells": _with(*_C) + "from cells",
    "q_cells_of_tables": _with(*_C) + "from cells",
    "q_joined_items": _with(*_Q) + """
        select i.session_id, i.quote_id, q.vendor_name, q.source_filename, sub_service, amount_cents, grand_total_cents
        from items i join quotes q on i.quote_id = q.quote_id""",
    "q_comparison_matrix": _with(*_D) + "from dense",
    "q_matrix_map": _with(*_D) + f"select {_ROW}, vendor, amount_cents from dense",
    "q_baseline": _with(*_B) + "from base",
    "q_vendor_list": _with(*_C, _VENDORS) + "from vendors",
    "q_category_groups": _with(*_B) + f"select {_ROW}, baseline_cents from base",
    "q_group_order": _with(_ITEMS) + "select session_id, service_category, min(pos) as first_pos from items group by all",
    "q_display_matrix": _with(*_D) + f"""
        select session_id, upper(service_category) as heading, sub_service, {_rupees('baseline_cents')} as baseline,
         split_part(vendor, ' (', 1) as vendor,
         case when amount_cents = 0 then 'N/A' else {_rupees('amount_cents')} end as price from dense""",
    "q_vendor_totals": _with(*_T) + "from totals",
    "q_chat_totals": _with(*_T) + "select session_id, vendor, total_cents as grand_total_cents from totals",
    "q_display_totals": _with(*_T) + f"""
        select session_id, vendor, '₹' || cast(t // 10 as varchar) || '.' || cast(t % 10 as varchar) || 'L' as axis,
         {_rupees('total_cents')} as tooltip
        from (select *, (total_cents + 500000) // 1000000 as t from totals)""",
    "q_vendor_rank": _with(*_T) + """
        select *, rank() over w as rank, dense_rank() over w as dense_rank from totals
        window w as (partition by session_id order by total_cents)""",
    "q_session_history": _with(*_Q) + """
        select session_id, count(*) as n_quotes, min(grand_total_cents) as lowest_cents,
         max(grand_total_cents) as highest_cents, max(grand_total_cents) - min(grand_total_cents) as spread_cents,
         cast(sum(grand_total_cents) as bigint) as sum_cents, min(quote_date) as first_date, max(quote_date) as last_date
        from quotes group by all""",
    "q_price_trend": _with(*_Q) + """
        select vendor_name, quote_date, n_quotes, mean_cents, case when quote_date is not null then
         mean_cents - lag(mean_cents) over (partition by vendor_name, quote_date is null order by quote_date) end as change_cents
        from (select vendor_name, case when grand_total_cents % 4 <> 2 then quote_date end as quote_date, count(*) as n_quotes,
          cast((2 * sum(grand_total_cents) + count(*)) // (2 * count(*)) as bigint) as mean_cents
         from quotes group by all)""",
    "q_session_status": _with(*_Q, _BARE, _STATUS) + """
        select session_id, coalesce(n_quotes, 0) as n_quotes, cast(coalesce(n_items, 0) as bigint) as n_items,
         case when coalesce(n_quotes, 0) = 0 then 'no_quotes' when n_items = 0 then 'no_items' else 'ok' end as status
        from asked left join per using (session_id)""",
    "q_comparable_sessions": _with(*_Q) + """
        select session_id, count(distinct quote_id) as n_quotes from quotes group by all
        having count(distinct quote_id) >= 2""",
    "q_orphan_quotes": _with(*_Q, _BARE) + """
        select session_id, quote_id, vendor_name, grand_total_cents from all_quotes q
        where not exists (select 1 from items i where i.quote_id = q.quote_id)""",
    "q_session_items": _with(_ITEMS) + "select session_id, quote_id, sub_service, quantity, amount_cents from items",
    "q_sync_quotes": _with(*_Q) + """
        select session_id, vendor_name, grand_total_cents, source_filename, 'mongodb_integrated' as source_type
        from quotes""",
    "q_sync_items": _with(_ITEMS) + f"select {_ITEM} from items",
    "q_extracted_quotes": _with(*_Q, _SENT) + """
        select sent_session as session_id, vendor_name, session_id as client_name, quote_date, grand_total_cents,
         source_filename from sent""",
    "q_extracted_items": _with(*_Q, _SENT) + """
        select sent_session as session_id, service_category, sub_service, work_title, description, quantity,
         pricing_method, rate_cents, amount_cents
        from items join (select quote_id, sent_session from sent) using (quote_id)""",
    "q_lane_union": _with(*_Q, _SENT) + """
        select session_id, vendor_name, grand_total_cents, source_filename, 'mongodb_integrated' as source_type,
         null::varchar as client_name, null::varchar as quote_date from quotes
        union all
        select sent_session, vendor_name, grand_total_cents, source_filename, null, session_id, quote_date from sent""",
    "q_quarantine": _with(*_Q) + """
        select session_id, case grand_total_cents % 8 when 0 then 'bad_vendor' when 1 then 'bad_number' when 3 then 'bad_quote'
          when 5 then 'bad_list' when 6 then 'bad_list' else 'unreadable' end as defects,
         case grand_total_cents % 8 when 3 then '5' when 4 then '{"quotes":null}' end as document, count(*) as n
        from quotes where grand_total_cents % 8 < 7 group by all""",
    "q_ingest_counts": _with(*_Q) + """
        select q.session_id, cast(sum(case when grand_total_cents % 8 = 3 then 2 else 1 end) as bigint) as n_received,
         count(*) filter (where grand_total_cents % 8 in (3, 7)) as n_quotes,
         cast(coalesce(sum(n) filter (where grand_total_cents % 8 in (3, 7)), 0) as bigint) as n_items,
         count(*) filter (where grand_total_cents % 8 < 7) as n_quarantined
        from quotes q join (select quote_id, count(*) as n from items group by all) using (quote_id) group by all""",
    "q_text_rows": _with(_ITEMS) + """
        select quote_id, sub_service, work_title || case when quantity = 3 then ' | deluxe' else '' end as work_title,
         cast(p_size as varchar) as sac_code, quantity, rate_cents,
         pricing_method, case when quantity = 1 then 0 else amount_cents end as amount_cents from items where quantity <> 2""",
    "q_damaged_items": _with(*_Q) + f"""
        select {_ITEM} from (select items.*, grand_total_cents from items join quotes using (quote_id, session_id))
        where grand_total_cents % 8 in (3, 7)""",
    "q_text_unparsed": _with(_ITEMS) + "select quote_id, count(*) as n_lines from items where quantity = 2 group by all",
    "q_text_quotes": _with(_ITEMS) + """
        select session_id, source_filename, case when not bool_or(quantity = 2) then cast(sum(case when quantity = 1 then 0
          else amount_cents end) as bigint) end as grand_total_cents,
         case when bool_or(quantity = 2) then 'unparsed_line' else '' end as defects
        from items group by session_id, quote_id, source_filename""",
    "q_stream_ingest": _with(_ITEMS) + f"select vendor_name, source_filename, {_ITEM} from items",
    "q_stream_cells": _with(*_C) + "from cells",
    "q_file_dedupe": _with(_ITEMS) + """
        select session_id, source_filename as name, cast(quantity as bigint) as size,
         min(case when l_linestatus = 'F' then 0 else 1 end) as batch,
         coalesce(min(pos) filter (where l_linestatus = 'F'), min(pos)) as pos
        from items where l_linestatus in ('F', 'O') group by session_id, source_filename, quantity""",
    "q_taxonomy_violations": _with(_ITEMS, _TAXONOMY, _USED) + "from used anti join taxonomy using (service_category, sub_service)",
    "q_taxonomy_conforming": _with(_ITEMS, _TAXONOMY, _USED) + "from used semi join taxonomy using (service_category, sub_service)",
    "q_taxonomy_official": _with(_ITEMS, _USED) + "select service_category, sub_service, ord, coalesce(n_items, 0) as n_items from (values "
    + ", ".join(f"('{c}', '{n}', {i})" for i, (c, n) in enumerate(OFFICIAL)) + """) as official(service_category, sub_service, ord)
        left join used using (service_category, sub_service)""",
    "q_taxonomy_snap": _with(_ITEMS, _TAXONOMY, _USED) + """
        select service_category, sub_service, snapped, distance from (
         select u.service_category, u.sub_service, t.sub_service as snapped,
          levenshtein(lower(u.sub_service), lower(t.sub_service)) as distance,
          row_number() over (partition by u.service_category, u.sub_service
           order by levenshtein(lower(u.sub_service), lower(t.sub_service)), t.sub_service) as r
         from used u left join (from taxonomy where service_category <> 'PROMO') t using (service_category)) where r = 1""",
    "q_taxonomy_uncovered": _with(*_C, _TAXONOMY, _UNCOVERED) + "from uncovered",
    "q_taxonomy_coverage": _with(*_C, _TAXONOMY, _UNCOVERED) + """
        select session_id, service_category, count(*) as n_uncovered from uncovered group by all""",
    "q_field_problems": _with(_ITEMS) + """
        select session_id, quote_id, sub_service, quantity,
         case when quantity = 1 then 'pricing_method' else 'rate_cents' end as problems
        from items where quantity = 1 or quantity >= 50""",
    "q_quote_problems": _with(*_Q) + """
        select session_id, quote_id, case grand_total_cents % 10 when 0 then 'vendor_name' when 1 then 'quote_date' else 'grand_total' end
         as problems from quotes where grand_total_cents % 10 < 3
        union all select 'bare_' || cast(s_suppkey as varchar), 'bare_q' || cast(s_suppkey as varchar), 'client_name,quote_date,services'
        from supplier""",
    "q_deviation": _with(*_B) + """
        select session_id, service_category, sub_service, vendor, n_providers, amount_cents, baseline_cents,
         amount_cents - baseline_cents as deviation_cents,
         cast(amount_cents - baseline_cents as double) * 100.0::double / cast(baseline_cents as double) as deviation_pct,
         case when amount_cents > baseline_cents then 'above' when amount_cents < baseline_cents then 'below'
          else 'at' end as position
        from cells join base using (session_id, service_category, sub_service)""",
    "q_overlap_services": _with(*_B) + "from base where n_providers >= 2",
    "q_common_scope": _with(*_B, _VENDORS, _NV) + """
        select base.* from base join nv using (session_id) where n_providers = n_vendors""",
    "q_scope_gaps": _with(*_D) + f"""
        select {_ROW}, vendor, n_providers, baseline_cents from dense where amount_cents <= 0 and n_providers > 0""",
    "q_extra_scope": _with(*_C) + f"""
        select {_ROW}, min(vendor) as vendor, cast(sum(amount_cents) as bigint) as amount_cents from cells
        where amount_cents > 0 group by {_ROW} having count(*) = 1""",
    "q_like_for_like": _with(*_S) + """
        select session_id, vendor, cast(total_cents as bigint) as total_cents, cast(common_cents as bigint) as common_cents,
         n_common, cast(shared_cents as bigint) as shared_cents, n_shared from per_vendor""",
    "q_gap_adjusted_total": _with(*_D) + """
        select session_id, vendor, cast(sum(amount_cents) as bigint) as total_cents,
         count(*) filter (where amount_cents <= 0) as n_missing,
         cast(coalesce(sum(baseline_cents) filter (where amount_cents <= 0), 0) as bigint) as missing_cents,
         cast(sum(case when amount_cents <= 0 then amount_cents + baseline_cents else amount_cents end) as bigint)
          as adjusted_cents
        from dense where n_providers > 0 group by session_id, vendor""",
    "q_missing_categories": _with(*_C, _VENDORS) + """,
        offers as (select session_id, service_category, vendor from cells where amount_cents > 0 group by all),
        offered as (select session_id, service_category, count(*) as n_providers from offers group by all)
        select o.session_id, o.service_category, v.vendor, o.n_providers
        from offered o join vendors v using (session_id)
        where not exists (select 1 from offers f where f.session_id = o.session_id
         and f.service_category = o.service_category and f.vendor = v.vendor)""",
    "q_scope_intersect": _with(*_T, _CELLS, _PAIRS) + f"""
        select {_ROW} from cells join pairs using (session_id) where vendor = vendor_a and amount_cents > 0
        intersect
        select {_ROW} from cells join pairs using (session_id) where vendor = vendor_b and amount_cents > 0""",
    "q_scope_except": _with(*_T, _CELLS, _PAIRS) + f"""
        select {_ROW} from cells join pairs using (session_id) where vendor = vendor_b and amount_cents > 0
        except
        select {_ROW} from cells join pairs using (session_id) where vendor = vendor_a and amount_cents > 0""",
    "q_amount_check": _with(_ITEMS) + """
        select session_id, quote_id, service_category, sub_service, work_title, quantity, rate_cents, amount_cents,
         amount_cents - cast(round(quantity * rate_cents) as bigint) as diff_cents
        from items where abs(amount_cents - cast(round(quantity * rate_cents) as bigint)) > 10""",
    "q_total_check": _with(*_Q, _BARE) + """
        select session_id, quote_id, coalesce(n_items, 0) as n_items, coalesce(items_cents, 0) as items_cents, grand_total_cents,
         grand_total_cents - coalesce(items_cents, 0) as diff_cents,
         cast(grand_total_cents - coalesce(items_cents, 0) as double) * 100.0::double
          / nullif(cast(coalesce(items_cents, 0) as double), 0) as diff_pct
        from all_quotes left join (select session_id, quote_id, count(*) as n_items, cast(sum(amount_cents) as bigint) as items_cents
         from items group by all) using (session_id, quote_id)""",
    "q_category_rollup": _with(*_C) + """
        select session_id, service_category, vendor, cast(grouping(session_id, service_category, vendor) as bigint) as level,
         cast(sum(amount_cents) as bigint) as total_cents
        from cells group by grouping sets ((session_id, service_category, vendor), (session_id, service_category), (session_id))""",
    "q_category_heatmap": _with(*_C) + """
        select session_id, service_category, vendor, amount_cents,
         cast(amount_cents as double) * 100.0::double / cast(sum(amount_cents) over (partition by session_id, vendor) as double)
          as share_pct
        from (select session_id, service_category, vendor, cast(sum(amount_cents) as bigint) as amount_cents
         from cells group by all)""",
    "q_category_columns": _with(*_C) + "select session_id, vendor, " + ", ".join(
        f"cast(coalesce(sum(amount_cents) filter (where service_category = '{c}'), 0) as bigint) as \"{c}\""
        for c in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    ) + " from cells group by session_id, vendor",
    "q_service_share": _with(*_C) + f"""
        select {_ROW}, vendor, amount_cents, vendor_cents,
         cast(amount_cents as double) * 100.0::double / cast(vendor_cents as double) as share_pct
        from (select *, cast(sum(amount_cents) over (partition by session_id, vendor) as bigint) as vendor_cents from cells)""",
    "q_cheapest_vendor": _with(*_C) + f"""
        select {_ROW}, vendor, amount_cents, highest_cents from (
         select *, row_number() over (partition by {_ROW} order by amount_cents, vendor) as r,
          max(amount_cents) over (partition by {_ROW}) as highest_cents from cells where amount_cents > 0)
        where r = 1""",
    "q_top_subservices": _with(_ITEMS, _COUNTS, _TOP) + "from top",
    "q_top_overall": _with(_ITEMS) + """
        select sub_service, count(*) as n from items group by all order by n desc, sub_service limit 20""",
    "q_rate_means": _with(_ITEMS, _COUNTS, _TOP) + f"""
        select session_id, sub_service, {_LABEL} as vendor, count(*) as n_rates,
         cast((2 * sum(rate_cents) + count(*)) // (2 * count(*)) as bigint) as mean_rate_cents
        from items semi join top using (session_id, sub_service) group by all""",
    "q_item_specs": _with(_ITEMS, _COUNTS, _TOP) + f"""
        select distinct session_id, sub_service, {_LABEL} as vendor, description
        from items semi join top using (session_id, sub_service)""",
    "q_chat_context": _with(*_T, _COUNTS, _TOP, _CHAT) + "from context",
    "q_chat_prompts": _with(*_T, _COUNTS, _TOP, _CHAT) + """
        select conv_id, turn, session_id, text as message, coalesce(n, 0) as n_entries,
         case when n is null then 'No quotes found for this session' end as error
        from (select conv_id, turn, 'session_' || cast(conv_id % 25 as varchar) || '_'
           || cast(conv_id // 25 % 250 * 5 as varchar) as session_id, text
         from conversations where role = 'user' and trim(text) <> '')
        left join (select session_id, count(*) as n from context group by all) using (session_id)""",
    "q_rule_summary": _with(*_T, _CELLS, _BASE, _VENDORS, _NV, _SCOPE, _SUMMARY) + "from summary",
    "q_report_context": _with(*_T, _CELLS, _BASE, _VENDORS, _DENSE, _SECTIONS) + """
        select session_id, 'matrix' as section, sort_number, sort_text, entry from table_rows
        union all select session_id, 'totals', sort_number, sort_text, entry from chart_rows""",
    "q_bundle": _with(*_T, _CELLS, _BASE, _VENDORS, _NV, _DENSE, _SCOPE, _SUMMARY, _SECTIONS) + """
        select session_id, 'report' as section, null::bigint as sort_number, '' as sort_text, summary as entry from summary
        union all select session_id, 'chartData', sort_number, sort_text, entry from chart_rows
        union all select session_id, 'tableData', sort_number, sort_text, entry from table_rows
        union all select session_id, 'vendors', null, vendor, vendor from vendors""",
}
ORACLES["q_red_flags"] = (
    "select * from (" + ORACLES["q_deviation"] + ") where n_providers >= 2 and abs(deviation_cents) * 100 >= baseline_cents * 50"
)

ORACLES["q_session_documents"] = "select session_id, section, entry from (" + ORACLES["q_bundle"] + ")"
ORACLES["q_kept_comparison"] = ORACLES["q_bundle"]

_BOTH_LANES = (
    _ITEMS.replace("items as (", "items0 as (", 1),
    _QUOTES.replace("quotes as (", "quotes0 as (", 1).replace("from items ", "from items0 "),
    _SENT.replace("sent as (", "sent0 as (", 1).replace("from quotes", "from quotes0"),
    """items as (select * from items0 union all
 select sent_session, items0.* exclude (session_id) from items0 join (select quote_id, sent_session from sent0) using (quote_id))""",
    """quotes as (select * from quotes0 union all select sent_session, sent0.* exclude (session_id, sent_session) from sent0)""",
)
ORACLES["q_stored_bundle"] = ORACLES["q_bundle"].replace(
    _with(*_Q).removeprefix("with ").rstrip("\n"), _with(*_BOTH_LANES).removeprefix("with ").rstrip("\n")
)


_EVENTS = """
events2 as (select *, epoch_us(ts) as us, cast(round(value * 100) as bigint) as cents, strftime(ts, '%Y-%m-%d') as day from events)"""
ORACLES["q_event_totals"] = _with(_EVENTS) + """
    select day, event_type, count(*) as n_records, cast(sum(cents) as bigint) as cents from events2 group by all"""
ORACLES["q_event_sittings"] = _with(_EVENTS, """
runs as (select *, sum(apart) over (partition by user_id order by us) as sitting_no from (
 select *, case when us - lag(us) over (partition by user_id order by us) <= 7200000000 then 0 else 1 end as apart from events2))""") + """
    select user_id, cast(sitting_no as bigint) as sitting_no, min(us) as started, max(us) as ended, count(*) as n_events, cast(sum(cents) as bigint) as cents
    from runs group by user_id, sitting_no"""

ORACLES["q_taxonomy_snap_whole"] = ORACLES["q_taxonomy_snap"].replace("(from taxonomy where service_category <> 'PROMO')", "taxonomy")
ORACLES["q_taxonomy_closest"] = """
with names as (
 select p_partkey, p_type as service_category, p_name || ' ' || substr(md5(cast(p_partkey as varchar)), 1, 6) as sub_service from part),
bank as (select distinct service_category, sub_service from names where p_partkey % 10 <> 0),
labels as (
 select distinct case when p_partkey % 5 = 0 then 'UNKNOWN' else service_category end as service_category,
  case p_partkey % 4 when 1 then substr(sub_service, 1, 2) || substr(sub_service, 4) when 2 then substr(sub_service, 1, 1) || 'x' || substr(sub_service, 3) || 'y'
   when 3 then upper(sub_service) else sub_service end as sub_service from names),
met as (
 select l.*, b.service_category as snapped_category, b.sub_service as snapped, cast(levenshtein(lower(l.sub_service), b.sub_service) as int) as distance
 from labels l join bank b on b.service_category = l.service_category or l.service_category = 'UNKNOWN')
select service_category, sub_service, snapped_category, snapped, distance from met
qualify row_number() over (partition by service_category, sub_service order by distance, snapped, snapped_category) = 1"""

_IN_TIME = """
lines as (select l_orderkey * 10 + l_linenumber as pos, s_name as vendor_name,
  cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as bigint) as order_day,
  cast(date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as bigint) as ship_day
 from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey),
dated as (select vendor_name, quote_id, grand_total_cents, cast(date_diff('day', date '1970-01-01', cast(quote_date as date)) as bigint) as quote_day from quotes)"""
ORACLES["q_quote_in_force"] = _with(_ITEMS, _QUOTES, _IN_TIME) + """
    select pos, l.vendor_name, ship_day, quote_id, grand_total_cents, quote_day
    from lines l asof left join (select * from dated qualify row_number() over (partition by vendor_name, quote_day order by quote_id desc) = 1) q
     on l.vendor_name = q.vendor_name and l.ship_day >= q.quote_day"""
ORACLES["q_quote_overlap"] = _with(_ITEMS, _QUOTES, _IN_TIME, """
held as (select *, coalesce(lead(quote_day) over (partition by vendor_name order by quote_day), quote_day + 90) as held_to
 from (select vendor_name, quote_day, count(*) as n_quotes from dated group by all))""") + """
    select vendor_name, quote_day, n_quotes, count(*) as n_lines,
     cast(sum(least(ship_day + 1, held_to) - greatest(order_day, quote_day)) as bigint) as open_days
    from lines join held using (vendor_name)
    where order_day < ship_day + 1 and order_day < held_to and quote_day < ship_day + 1 group by all"""
ORACLES["q_price_quantiles"] = _with(_ITEMS, """
placed as (select session_id, rate_cents, row_number() over (partition by session_id order by rate_cents) as place,
  count(*) over (partition by session_id) as n from items where rate_cents is not null)""") + """
    select session_id, share, n as n_prices, true as inside, case when n <= 400 then rate_cents end as price_cents
    from placed, (values (0.25::double), (0.5::double), (0.75::double)) v(share) where place = greatest(ceil(share * n), 1)"""
_SAMPLE = _with(_ITEMS, """
numbered as (select session_id, pos, amount_cents, count(*) as n_alike,
  ('0x' || substr(sha256('2024|=' || pos || '|=' || amount_cents), 1, 12))::bigint as number from items group by all),
placed as (select *, row_number() over (partition by session_id order by number, pos, amount_cents) as place from numbered),
sampled as (select session_id, pos, amount_cents, n_alike, number, cast(place as int) as place,
  coalesce((select p.number from placed p where p.session_id = s.session_id and p.place = 51), 281474976710656) as threshold
 from placed s where place <= 50)""")
ORACLES["q_session_sample"] = _SAMPLE + "from sampled"
ORACLES["q_sample_estimates"] = _SAMPLE + """
    select session_id, count(*) as n_sampled, threshold,
     cast(floor(sum(n_alike)::double * 281474976710656 / threshold) as bigint) as estimated_rows,
     cast(floor(sum(amount_cents * n_alike)::double * 281474976710656 / threshold) as bigint) as estimated_sum
    from sampled group by session_id, threshold"""
ORACLES["q_exported_cells"] = ORACLES["q_cells"]
