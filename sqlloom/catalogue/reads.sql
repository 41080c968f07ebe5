-- func: scan_projection
select c_custkey, c_name as name, c_acctbal as balance from customer

-- func: star_distinct
select distinct o_orderstatus, o_orderpriority from orders

-- func: star_expansion
select n.* from nation as n where n.n_regionkey = @region

-- func: values_rows
select column_a, column_b from (values (1, 'one'), (2, 'two'), (3, null)) as v(column_a, column_b)

-- func: no_from
-- cardinality: one
select cast(@value as integer) as value, 'text''s' as word

-- func: filter_compare
select o_orderkey, o_totalprice from orders where o_totalprice >= @least and @most > o_totalprice and o_orderstatus <> 'P'

-- func: filter_is
select o_orderkey, nullif(o_orderstatus, 'F') as status from orders where nullif(o_orderstatus, 'F') is not @status

-- func: filter_null
select count(*) as n, count(nullif(o_orderstatus, 'F')) as known from orders where nullif(o_orderpriority, '5-LOW') is not null

-- func: optional_filter
select o_orderkey, o_orderstatus from orders where (@status is null or o_orderstatus = @status) and (@custkey is null or o_custkey = @custkey)

-- func: sentinel_filter
select o_orderkey, o_custkey from orders where @custkey = -1 or o_custkey = @custkey

-- func: like_nocase
select p_partkey, p_name from part where p_name like @pattern and p_name not like '%zzz%'

-- func: in_list
select n_nationkey, n_name from nation where n_regionkey in (@a, @b) and n_nationkey not in (3, 4)

-- func: in_subquery
select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1) and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')

-- func: tuple_in
select o_orderkey from orders where (o_orderstatus, o_orderpriority) in (select o_orderstatus, max(o_orderpriority) from orders group by o_orderstatus)

-- func: between_range
select p_partkey, p_size from part where p_size between @low and @high and p_retailprice not between 1000 and 1200

-- func: exists_rows
select o_orderkey, cast(exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45) as bigint) as large from orders

-- func: not_exists
select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)

-- func: scalar_subquery
select c_custkey, (select max(o_totalprice) from orders where o_custkey = c_custkey) as most from customer

-- func: connectives
select p_partkey from part where (p_size < 5 or p_size > 45) and not (p_brand = 'Brand#11')

-- func: quoted_names
select "c_custkey" as "the key", `c_name` from "customer" where "c_nationkey" = 7

-- func: collate_order
select n_nationkey, n_name from nation order by n_name collate nocase, n_nationkey limit 10

-- func: join_inner
select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_mktsegment = @segment

-- func: join_left
select o.o_orderkey, l.l_linenumber, l.l_quantity from orders o left outer join lineitem l on l.l_orderkey = o.o_orderkey and l.l_quantity > 49

-- func: join_right
select l.l_linenumber, o.o_orderkey from lineitem l right join orders o on l.l_orderkey = o.o_orderkey and l.l_quantity < 2

-- func: join_full
select c.c_custkey, s.s_suppkey from customer c full outer join supplier s on c.c_custkey = s.s_suppkey + 50 and c.c_custkey < 120

-- func: join_cross
select r_name, n_name from region cross join nation

-- func: join_comma
select n_name, r_name from nation, region where n_regionkey = r_regionkey

-- func: join_natural
select n_nationkey, n_name, pair from nation natural join (select n_nationkey, n_regionkey as pair from nation) as other

-- func: join_using
select n_nationkey, a.n_name as left_name, b.n_name as right_name from nation a join nation b using (n_nationkey)

-- func: join_self
select a.n_nationkey as first_key, b.n_nationkey as second_key from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey

-- func: join_derived
select c_name, t.orders_made from customer join (select o_custkey, count(*) as orders_made from orders group by o_custkey) as t on t.o_custkey = c_custkey

-- func: join_theta
select p_partkey, band from part join (values (0, 10, 'small'), (8, 30, 'middle'), (25, 60, 'large')) as b(low, high, band) on p_size >= b.low and p_size < b.high + @step

-- func: join_semi
select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')

-- func: join_anti
select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)

-- func: join_left_reduced
select o_orderkey, l_quantity from orders left join lineitem on l_orderkey = o_orderkey where l_quantity > 48

-- func: agg_global
select count(*) as n, count(distinct o_custkey) as customers, min(o_orderdate) as first_day, max(o_totalprice) as most from orders

-- func: agg_group
select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) as price, cast(sum(l_quantity) as double) as quantity from lineitem group by l_returnflag, l_linestatus

-- func: agg_average
select p_brand, round(avg(p_size), 6) as mean_size, min(p_type) as first_type from part group by p_brand

-- func: agg_having
select o_custkey, count(*) as n from orders group by o_custkey having count(*) >= @least and max(o_totalprice) > 1000

-- func: agg_filter
select o_orderpriority, count(*) filter (where o_orderstatus = @status) as n, count(*) as total_rows from orders group by o_orderpriority

-- func: agg_distinct
select c_mktsegment, count(distinct c_nationkey) as nations from customer group by c_mktsegment

-- func: agg_total
select n_regionkey, total(nullif(n_nationkey, n_nationkey)) as nothing, total(n_nationkey) as everything from nation group by n_regionkey

-- func: agg_minmax
select l_orderkey, l_linenumber, max(l_quantity, 10.0, l_tax) as largest, min(nullif(l_linenumber, 3), 2) as smallest from lineitem

-- func: agg_any_value
select o_custkey, o_totalprice as last_price, o_orderstatus as last_status, max(o_orderkey) as last_order from orders group by o_custkey

-- func: coalesce_max_plus
select coalesce(max(o_orderkey), 0) + 1 as next_key, cast(coalesce(sum(o_custkey), 0) as bigint) as keys from orders

-- func: json_group_array
select n_regionkey, json_group_array(n_nationkey order by n_nationkey) as nations, json_group_array(nullif(n_name, 'NATION_3') order by n_nationkey) as names from nation group by n_regionkey

-- func: win_row_number
select o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as bigint) as place from orders

-- func: win_rank
select p_partkey, cast(rank() over (partition by p_brand order by p_size) as bigint) as place from part

-- func: win_dense_rank
select p_partkey, cast(dense_rank() over (partition by p_brand order by p_size desc) as bigint) as place from part

-- func: win_ntile
select s_suppkey, cast(ntile(4) over (partition by s_nationkey order by s_suppkey) as bigint) as part_of from supplier

-- func: win_aggregate
select o_orderkey, count(*) over (partition by o_custkey) as orders_made, max(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row) as recent_most from orders

-- func: win_lag
select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before, lead(o_orderkey, 1, -1) over (partition by o_custkey order by o_orderdate, o_orderkey) as after from orders

-- func: order_case
select o_orderkey, o_orderstatus from orders order by case when o_orderstatus = @first then 0 else 1 end, o_orderkey limit 25

-- func: limit_offset
select c_custkey, c_name from customer order by c_custkey limit @size offset @skip

-- func: topk
select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit @k

-- func: top1_per_parent
select c_custkey, (select o_orderkey from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 1) as best from customer

-- func: union_distinct
select c_nationkey as nationkey from customer union select s_nationkey from supplier

-- func: union_all
select c_nationkey as nationkey, 'customer' as kind from customer union all select s_nationkey, 'supplier' from supplier

-- func: intersect_rows
select c_nationkey as nationkey from customer intersect select s_nationkey from supplier

-- func: except_rows
select n_nationkey as nationkey from nation except select s_nationkey from supplier where s_acctbal > @least

-- func: compound_subquery
select kind, k, count(*) as n from (select 'c' as kind, c_nationkey as k from customer union all select 's', s_nationkey from supplier) as u group by kind, k

-- func: cte_single
with busy (custkey, n) as (select o_custkey, count(*) from orders group by o_custkey) select custkey, n from busy where n > @least

-- func: cte_multiple
with a as materialized (select n_nationkey, n_regionkey from nation), b as not materialized (select r_regionkey, r_name from region) select n_nationkey, r_name from a join b on n_regionkey = r_regionkey

-- func: cte_recursive
with recursive counter(n) as (select 1 union all select n + 1 from counter where n < @most) select cast(n as bigint) as n from counter

-- func: cte_shadow
with nation as (select r_regionkey as n_nationkey from region) select n_nationkey from nation

-- func: derived_table
select status, n from (select o_orderstatus as status, count(*) as n from orders group by o_orderstatus) as t where n > 1

-- func: arith
select l_orderkey, l_linenumber, l_quantity + 1 as up, l_quantity - l_tax as down, -l_linenumber as neg, l_linenumber * 3 as triple from lineitem

-- func: int_div
select p_partkey, p_size div 7 as sevenths, p_size % 7 as rest from part

-- func: safe_div
select p_partkey, p_retailprice / (p_size - 10) as per_size from part

-- func: bitops
select p_partkey, cast(p_size & 12 as bigint) as masked, cast(p_size | 1 as bigint) as odd, cast(p_size << 2 as bigint) as up, cast(p_size >> 1 as bigint) as down, cast(1 + p_size << 1 + 1 as bigint) as ordered, cast(p_size & 7 | 8 << 1 as bigint) as leftmost from part

-- func: concat_text
select n_nationkey, n_name || '/' || nullif(n_name, 'NATION_3') as label from nation

-- func: cast_types
select p_partkey, cast(p_retailprice as integer) as whole, cast(p_size as text) as shown, cast(p_size as double) as real_size from part

-- func: cast_prefix
select n_nationkey, cast(n_nationkey || '-' || n_name as integer) as digits, cast(substr(n_name, 1, 3) as integer) as none from nation

-- func: coalesce_first
select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as segment, ifnull(nullif(c_nationkey, 1), -1) as nation from customer

-- func: case_searched
select o_orderkey, case when o_totalprice > @high then 'high' when o_totalprice > 1000 then 'middle' end as band from orders

-- func: case_simple
select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 else 0 end as code from orders

-- func: text_functions
select n_nationkey, lower(n_name) as low, upper(n_name) as up, length(trim('  ' || n_name || ' ')) as size, substr(n_name, 2, 3) as middle, replace(n_name, 'N', 'M') as swapped from nation

-- func: unixepoch
select event_id, datetime(event_id * 3600, 'unixepoch') as shown from events

-- func: json_object
select n_nationkey, json_object('key', n_nationkey, 'name', nullif(n_name, 'x'), 'none', nullif(n_nationkey, n_nationkey)) as packed from nation

-- func: json_array
select n_nationkey, json_array(n_nationkey, n_name, null) as packed from nation

-- func: json_each
select e.event_id, j.key, j.value, j.type, j.fullkey from events as e, json_each(e.props) as j

-- func: json_tree
select e.event_id, j.key, j.value, j.type, j.fullkey, j.path from events as e, json_tree(e.props) as j

-- func: json_member
select event_id from events where '5' in (select value from json_each('["5", "6"]')) and props ->> '$.k' in (select value from json_each('[5, 6, "7"]'))

-- func: glob_match
select p_partkey, p_brand glob 'Brand#[12]?' as early, p_type glob '*S*' as has_s from part

-- func: strftime_parts
select event_id, strftime('%Y/%m, day %d', ts) as shown, date(ts, 'start of month') as month_began, datetime(ts, '+3 days', '-1 hour') as later from events

-- func: is_precedence
select l_orderkey, l_linenumber from lineitem where l_linenumber + 1 is not l_suppkey % 5 + 1

-- func: case_operand
select o_orderkey, case o_orderstatus when 'F' then 8 else 6 end % 5 as rest, case when o_custkey > 50 then 1 end is null as low from orders

-- func: hex_literal
select n_nationkey + 0x1F as shifted from nation

-- func: props_json
select event_id, cast(get_json_object(props, '$.k') as bigint) as k from events

-- func: text_search
select doc_id from documents where text match 'the AND harbour OR und'

-- func: view_read
select c_custkey, n from busy_customers where n >= @least

-- func: orders_by_customer
select o_orderkey, o_orderdate, o_totalprice from orders where o_custkey = @custkey order by o_orderkey limit @n
