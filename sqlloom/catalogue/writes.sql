-- func: insert_values
insert into supplier (s_suppkey, s_name, s_nationkey) values (900001, 'new one', 3), (900002, 'new two', null)

-- func: insert_rowid
insert into supplier (s_name, s_nationkey, s_acctbal) values ('numbered', 1, 5.5), ('numbered too', 2, 6.5)

-- func: insert_select
insert into supplier (s_suppkey, s_name, s_nationkey, s_acctbal) select s_suppkey + 500000, upper(s_name), s_nationkey, s_acctbal * 2 from supplier where s_nationkey < 5

-- func: insert_batch
-- batch
insert into supplier (s_suppkey, s_name) values (@key, @name)

-- func: update_where
update supplier set s_acctbal = s_acctbal + @bonus, s_name = s_name || '!' where s_nationkey = @nation

-- func: update_from
update supplier set s_name = n.n_name from nation as n where n.n_nationkey = supplier.s_nationkey and n.n_regionkey = 1

-- func: delete_where
delete from supplier where s_nationkey = @nation

-- func: delete_cte
with small as (select n_nationkey from nation where n_regionkey = 2) delete from supplier where s_nationkey in (select n_nationkey from small)

-- func: insert_replace
insert or replace into supplier (s_suppkey, s_name, s_nationkey, s_acctbal) values (1, 'replaced', 9, 1.0), (900001, 'added', 9, 2.0)

-- func: insert_ignore
insert or ignore into supplier (s_suppkey, s_name) values (1, 'ignored'), (900001, 'kept'), (900001, 'late')

-- func: upsert_update
insert into supplier (s_suppkey, s_name, s_nationkey, s_acctbal) values (2, 'up', 7, 100.0), (3, 'down', 7, -5000.0), (900001, 'fresh', 7, 1.0)
on conflict (s_suppkey) do update set s_name = excluded.s_name, s_acctbal = supplier.s_acctbal + excluded.s_acctbal where excluded.s_acctbal > 0

-- func: upsert_nothing
insert into supplier (s_suppkey, s_name) values (2, 'no'), (900001, 'yes') on conflict (s_suppkey) do nothing

-- func: returning_update
update supplier set s_nationkey = s_nationkey + 100 where s_suppkey <= 5 returning s_suppkey, s_nationkey, s_name || '*' as label

-- func: returning_delete
delete from supplier where s_suppkey <= 4 returning s_suppkey, s_name

-- func: returning_insert
insert into supplier (s_suppkey, s_name, s_nationkey) values (900001, 'new', 3) returning *
