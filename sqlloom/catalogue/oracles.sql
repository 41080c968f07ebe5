-- func: star_expansion
select * from nation where n_regionkey = 2
-- func: no_from
select 42::bigint as value, 'text''s' as word
-- func: filter_compare
select o_orderkey, o_totalprice from orders where o_totalprice >= 20000 and 90000 > o_totalprice and o_orderstatus <> 'P'
-- func: filter_is
select o_orderkey, nullif(o_orderstatus, 'F') as status from orders where nullif(o_orderstatus, 'F') is distinct from 'O'
-- func: optional_filter
select o_orderkey, o_orderstatus from orders where o_orderstatus = 'O'
-- func: sentinel_filter
select o_orderkey, o_custkey from orders
-- func: like_nocase
select p_partkey, p_name from part where p_name ilike '%WIDGET%' and p_name not ilike '%zzz%'
-- func: in_list
select n_nationkey, n_name from nation where n_regionkey in (1, 3) and n_nationkey not in (3, 4)
-- func: between_range
select p_partkey, p_size from part where p_size between 10 and 20 and p_retailprice not between 1000 and 1200
-- func: quoted_names
select c_custkey as "the key", c_name from customer where c_nationkey = 7
-- func: collate_order
select n_nationkey, n_name from nation order by lower(n_name), n_nationkey limit 10
-- func: join_inner
select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'
-- func: join_theta
select p_partkey, band from part join (values (0, 10, 'small'), (8, 30, 'middle'), (25, 60, 'large')) as b(low, high, band) on p_size >= b.low and p_size < b.high + 2
-- func: agg_having
select o_custkey, count(*) as n from orders group by o_custkey having count(*) >= 12 and max(o_totalprice) > 1000
-- func: agg_filter
select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as n, count(*) as total_rows from orders group by o_orderpriority
-- func: agg_total
select n_regionkey, 0.0::double as nothing, cast(sum(n_nationkey) as double) as everything from nation group by n_regionkey
-- func: agg_minmax
select l_orderkey, l_linenumber, greatest(l_quantity, 10.0, l_tax) as largest, case when l_linenumber = 3 then null else least(l_linenumber, 2) end as smallest from lineitem
-- func: coalesce_max_plus
select coalesce(max(o_orderkey), 0) + 1 as next_key, cast(coalesce(sum(o_custkey), 0) as bigint) as keys from orders
-- func: json_group_array
select n_regionkey, '[' || string_agg(n_nationkey::varchar, ',' order by n_nationkey) || ']' as nations, '[' || string_agg(case when n_name = 'NATION_3' then 'null' else '"' || n_name || '"' end, ',' order by n_nationkey) || ']' as names from nation group by n_regionkey
-- func: order_case
select o_orderkey, o_orderstatus from orders order by case when o_orderstatus = 'P' then 0 else 1 end, o_orderkey limit 25
-- func: limit_offset
select c_custkey, c_name from customer order by c_custkey limit 20 offset 30
-- func: topk
select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10
-- func: union_all
select c_nationkey as nationkey, 'customer' as kind from customer union all select s_nationkey, 'supplier' from supplier
-- func: except_rows
select n_nationkey as nationkey from nation except select s_nationkey from supplier where s_acctbal > 9000
-- func: cte_single
select o_custkey as custkey, count(*) as n from orders group by o_custkey having count(*) > 12
-- func: cte_multiple
select n_nationkey, r_name from nation join region on n_regionkey = r_regionkey
-- func: cte_recursive
select i::bigint as n from range(1, 151) as t(i)
-- func: cte_shadow
select r_regionkey as n_nationkey from region
-- func: int_div
select p_partkey, p_size // 7 as sevenths, p_size % 7 as rest from part
-- func: safe_div
select p_partkey, case when p_size = 10 then null else p_retailprice / (p_size - 10) end as per_size from part
-- func: bitops
select p_partkey, (p_size & 12)::bigint as masked, (p_size | 1)::bigint as odd, (p_size * 4)::bigint as up, (p_size >> 1)::bigint as down, ((1 + p_size) * 4)::bigint as ordered, (((p_size & 7) | 8) * 2)::bigint as leftmost from part
-- func: cast_types
select p_partkey, cast(trunc(p_retailprice) as bigint) as whole, cast(p_size as varchar) as shown, cast(p_size as double) as real_size from part
-- func: cast_prefix
select n_nationkey, n_nationkey::bigint as digits, 0::bigint as none from nation
-- func: case_searched
select o_orderkey, case when o_totalprice > 50000 then 'high' when o_totalprice > 1000 then 'middle' end as band from orders
-- func: unixepoch
select event_id, strftime(to_timestamp(event_id * 3600) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as shown from events
-- func: json_object
select n_nationkey, '{"key":' || n_nationkey || ',"name":"' || n_name || '","none":null}' as packed from nation
-- func: json_array
select n_nationkey, '[' || n_nationkey || ',"' || n_name || '",null]' as packed from nation
-- func: json_each
select event_id, 'k' as key, json_extract_string(props, '$.k') as value, 'integer' as type, '$.k' as fullkey from events
-- func: props_json
select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events
-- func: text_search
select doc_id from (select doc_id, string_split_regex(lower(text), '[^\p{L}\p{N}]+') as w from documents) where list_contains(w, 'the') and list_contains(w, 'harbour') or list_contains(w, 'und')
-- func: view_read
select o_custkey as c_custkey, count(*) as n from orders group by o_custkey having count(*) >= 13
-- func: coalesce_first
select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as segment, coalesce(nullif(c_nationkey, 1), -1) as nation from customer
-- func: orders_by_customer
select o_orderkey, o_orderdate, o_totalprice from orders where o_custkey = 7 order by o_orderkey limit 5
-- func: insert_values
select s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier union all select * from (values (900001, 'new one', 3, 0.0), (900002, 'new two', null, 0.0))
-- func: insert_rowid
select s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier union all select (select max(s_suppkey) from supplier) + k, n, nk, b from (values (1, 'numbered', 1, 5.5), (2, 'numbered too', 2, 6.5)) as t(k, n, nk, b)
-- func: insert_select
select s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier union all select s_suppkey + 500000, upper(s_name), s_nationkey, s_acctbal * 2 from supplier where s_nationkey < 5
-- func: insert_batch
select s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier union all select * from (values (900001, 'first', null::bigint, 0.0), (900002, 'second', null, 0.0), (900003, 'third', null, 0.0))
-- func: update_where
select s_suppkey, case when s_nationkey = 3 then s_name || '!' else s_name end as s_name, s_nationkey::bigint as s_nationkey, case when s_nationkey = 3 then s_acctbal + 10.5::double else s_acctbal end as s_acctbal from supplier
-- func: update_from
select s_suppkey, coalesce((select n_name from nation where n_nationkey = s_nationkey and n_regionkey = 1), s_name) as s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier
-- func: delete_where
select s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier where s_nationkey <> 4
-- func: delete_cte
select s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey = 2)
-- func: insert_replace
select s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier where s_suppkey <> 1 union all select * from (values (1, 'replaced', 9, 1.0), (900001, 'added', 9, 2.0))
-- func: insert_ignore
select s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier union all select 900001, 'kept', null, 0.0
-- func: upsert_update
select s_suppkey, case when s_suppkey = 2 then 'up' else s_name end as s_name, s_nationkey::bigint as s_nationkey, case when s_suppkey = 2 then s_acctbal + 100.0::double else s_acctbal end as s_acctbal from supplier union all select 900001, 'fresh', 7, 1.0
-- func: upsert_nothing
select s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier union all select 900001, 'yes', null, 0.0
-- func: returning_update
select s_suppkey, (s_nationkey + 100)::bigint as s_nationkey, s_name || '*' as label from supplier where s_suppkey <= 5
-- func: returning_delete
select s_suppkey, s_name from supplier where s_suppkey <= 4
-- func: returning_insert
select 900001::bigint as s_suppkey, 'new' as s_name, 3::bigint as s_nationkey, 0.0::double as s_acctbal
-- func: agg_any_value
select o_custkey, arg_max(o_totalprice, o_orderkey) as last_price, arg_max(o_orderstatus, o_orderkey) as last_status, max(o_orderkey) as last_order from orders group by o_custkey
-- func: json_tree
select event_id, null as key, replace(props, ': ', ':') as value, 'object' as type, '$' as fullkey, '$' as path from events union all select event_id, 'k', json_extract_string(props, '$.k'), 'integer', '$.k', '$' from events
-- func: json_member
select event_id from events where json_extract_string(props, '$.k') in ('5', '6', '7')
-- func: glob_match
select p_partkey, regexp_full_match(p_brand, 'Brand#[12].') as early, contains(p_type, 'S') as has_s from part
-- func: strftime_parts
select event_id, strftime(ts, '%Y/%m, day %d') as shown, strftime(date_trunc('month', ts), '%Y-%m-%d') as month_began, strftime(ts + interval 3 day - interval 1 hour, '%Y-%m-%d %H:%M:%S') as later from events
-- func: is_precedence
select l_orderkey, l_linenumber from lineitem where (l_linenumber + 1) is distinct from ((l_suppkey % 5) + 1)
-- func: case_operand
select o_orderkey, (case o_orderstatus when 'F' then 8 else 6 end) % 5 as rest, not (o_custkey > 50) as low from orders
-- func: hex_literal
select n_nationkey + 31 as shifted from nation
