"""What queries return over the ferries, against SQL over the same rows."""

import pytest

GOALS = "select goal_port from sailing where hull = "
#: path query: SQL with the same rows
ANSWERS = {
    # steps, brackets, absence
    "LIST f FROM Ferry [has Fuel: 'electric'] has FerryName f": "select ferry_name from ferry where fuel = 'electric'",
    "LIST f, p FROM Ferry has FerryName f AND ALSO lies in Port has PortName p": "select ferry_name, port_name from ferry join port on home = port_id",
    "list f from Ferry has FerryName f and also has Seats s where s is less than or equal to 120": "select ferry_name from ferry where seats <= 120",
    "LIST f FROM Ferry has FerryName f BUT NOT runs Sailing": "select ferry_name from ferry where hull not in (select hull from sailing)",
    "LIST g FROM Goods has GoodsName g BUT NOT travels as Cargo is on Sailing goes to Port: 2": "select goods_name from goods where goods_code not in (select goods_code from cargo join sailing using (sailing_nr) where goal_port = 2)",
    "LIST f FROM Ferry has FerryName f BUT NOT lies in Port": "select ferry_name from ferry where home is null",
    "LIST n, d FROM Sailing has SailingNr n AND ALSO goes to Port has Depth d WHERE d < 5": "select sailing_nr, depth from sailing join port on goal_port = port_id where depth < 5",
    "LIST g, t FROM Cargo: (5, 'SA') is of Goods has GoodsName g AND ALSO has Tonnes t": "select goods_name, tonnes from cargo join goods using (goods_code) where sailing_nr = 5 and goods_code = 'SA'",
    # counts
    "THE COUNT OF Sailing has Riders": "select count(riders) from sailing",
    "THE COUNT OF Ferry runs Sailing": "select count(*) from sailing",
    "THE COUNT OF Ferry [runs Sailing]": "select count(distinct hull) from sailing",
    "THE COUNT OF Port is goal of Sailing starts in Port": "select count(*) from sailing",
    "THE COUNT OF Ferry lies in Port shelters Ferry": "select count(*) from ferry a join ferry b on a.home = b.home",
    "THE COUNT OF DISTINCT Port [is start of Sailing [has Fare x] WHERE x < 10]": "select count(distinct start_port) from sailing where fare < 10",
    "LIST THE COUNT OF Ferry AS f, THE COUNT OF Port AS p, THE COUNT OF Ferry [lies in Port] * 100 / THE COUNT OF Ferry AS share": "select 5, 4, 80.0",
    # a value that the path repeats counts once for what has it
    "THE SUM OF s IN Sailing is run by Ferry has Seats s": "select sum(seats) from ferry where hull in (select hull from sailing)",
    "THE SUM OF s IN Ferry has Seats s AND ALSO runs Sailing x": "select sum(seats) from ferry where hull in (select hull from sailing)",
    "THE SUM OF h IN Cargo is of Goods has Hazard h": "select sum(hazard) from goods where goods_code in (select goods_code from cargo)",
    "THE AVERAGE x IN Sailing has Fare x AND ALSO carries Cargo c": "select avg(fare) from sailing where sailing_nr in (select sailing_nr from cargo)",
    "LIST n, t FROM Port has PortName n AND ALSO is start of Sailing is run by Ferry has Seats s AND ALSO THE SUM OF s GROUPED BY n AS t": "select port_name, sum(seats) from (select distinct port_name, hull, seats from port join sailing on start_port = port_id join ferry using (hull)) group by 1",
    "LIST n, t FROM Ferry f has FerryName n AND ALSO has Seats s AND ALSO runs Sailing x AND ALSO THE SUM OF s GROUPED BY f AS t": "select ferry_name, seats from ferry where hull in (select hull from sailing)",
    "LIST n, t FROM Ferry has FerryName n AND ALSO runs Sailing carries Cargo has Tonnes x AND ALSO THE SUM OF x GROUPED BY n AS t": "select ferry_name, sum(tonnes) from ferry join sailing using (hull) join cargo using (sailing_nr) group by 1",
    "LIST n, t FROM Sailing is run by Ferry has FerryName n AND ALSO has Fare x AND ALSO carries Cargo c AND ALSO THE SUM OF x GROUPED BY n AS t": "select ferry_name, sum(fare) from ferry join sailing using (hull) where sailing_nr in (select sailing_nr from cargo) group by 1",
    "LIST h, m FROM Goods has Hazard h AND ALSO travels as Cargo is on Sailing has Fare x AND ALSO THE MAXIMUM x GROUPED BY h AS m": "select hazard, max(fare) from goods join cargo using (goods_code) join sailing using (sailing_nr) group by 1",
    # levels
    "THE AVERAGE c IN (Sailing x is run by Ferry f AND ALSO THE COUNT OF x GROUPED BY f AS c)": "select avg(c) from (select count(*) as c from sailing group by hull)",
    "DEFINE Load ::= LIST s, t FROM Sailing s carries Cargo has Tonnes x AND ALSO THE SUM OF x GROUPED BY s AS t\nLIST n, t FROM Sailing has SailingNr n AND ALSO has Load LoadT t WHERE t > 5": "select sailing_nr, sum(tonnes) from cargo group by 1 having sum(tonnes) > 5",
    "DEFINE Busy ::= LIST f FROM Ferry f runs Sailing x AND ALSO THE COUNT OF x GROUPED BY f AS c WHERE c > 1\nDEFINE Quiet ::= LIST b FROM Busy b has Fuel: 'electric'\nLIST n FROM Quiet has FerryName n": "select ferry_name from ferry where fuel = 'electric' and hull in (select hull from sailing group by 1 having count(*) > 1)",
    # conditions over other rows
    "LIST n FROM Sailing has SailingNr n AND ALSO has Fare x AND ALSO goes to Port p WHERE x > THE AVERAGE Sailing [goes to Port: !p] has Fare": "select sailing_nr from sailing a where fare > (select avg(fare) from sailing b where a.goal_port = b.goal_port)",
    "LIST n, c FROM Port p has PortName n AND ALSO THE COUNT OF Ferry [lies in Port: !p] AS c": "select port_name, (select count(*) from ferry where home = port_id) from port",
    "LIST n FROM Ferry has FerryName n AND ALSO (has Fuel: 'steam' OR OTHERWISE lies in Port: 2)": "select ferry_name from ferry where fuel = 'steam' or home = 2",
    "Ferry has Fuel: 'steam' OR OTHERWISE lies in Port: 2": "select hull from ferry where fuel = 'steam' or home = 2",
    "LIST n FROM Ferry has FerryName n WHERE runs Sailing goes to Port: 4 OR n = 'Elster'": "select ferry_name from ferry where hull in (select hull from sailing where goal_port = 4) or ferry_name = 'Elster'",
    "LIST n FROM Ferry has FerryName n WHERE NOT runs Sailing carries Cargo": "select ferry_name from ferry where hull not in (select hull from sailing join cargo using (sailing_nr))",
    "LIST n FROM Ferry has FerryName n AND ALSO has Seats s WHERE s > 100 EXCLUSIVE OR starts_with(n, 'b')": "select ferry_name from ferry where (seats > 100) <> (ferry_name ilike 'b%')",
    # sets
    "LIST n FROM Ferry has FerryName n AND ALSO runs Sailing goes to Port WHICH ARE ALL IN Ferry: 11 runs Sailing goes to Port": f"select ferry_name from ferry f where not exists ({GOALS}f.hull except {GOALS}11)",
    "LIST n FROM Ferry has FerryName n AND ALSO runs Sailing goes to Port THAT INCLUDES ALL Ferry: 14 runs Sailing goes to Port": f"select ferry_name from ferry f where not exists ({GOALS}14 except {GOALS}f.hull)",
    "LIST n FROM Ferry has FerryName n AND ALSO runs Sailing goes to Port MATCHING ALL Ferry: 12 runs Sailing goes to Port": f"select ferry_name from ferry f where not exists ({GOALS}12 except {GOALS}f.hull) and not exists ({GOALS}f.hull except {GOALS}12)",
    "LIST n FROM Ferry has FerryName n WHERE runs Sailing goes to Port EXCLUDES Ferry: 13 runs Sailing goes to Port": f"select ferry_name from ferry f where not exists ({GOALS}f.hull intersect {GOALS}13)",
    "LIST n FROM Ferry has FerryName n WHERE NOT runs Sailing goes to Port IS A SUBSET OF Ferry: 11 runs Sailing goes to Port": f"select ferry_name from ferry f where exists ({GOALS}f.hull except {GOALS}11)",
    "LIST n FROM Ferry has FerryName n WHERE runs Sailing goes to Port IS A PROPER SUPERSET OF Ferry: 14 runs Sailing goes to Port": f"select ferry_name from ferry f where not exists ({GOALS}14 except {GOALS}f.hull) and exists ({GOALS}f.hull except {GOALS}14)",
    "LIST n FROM Ferry has FerryName n WHERE Ferry: 15 runs Sailing goes to Port IS A SUBSET OF Ferry: 11 runs Sailing goes to Port": "select ferry_name from ferry",
    "LIST n FROM Ferry has FerryName n WHERE runs Sailing goes to Port IS A SUPERSET OF (LIST p FROM Port p has Depth d ORDERED WITH d DESCENDING THE FIRST 2)": f"select ferry_name from ferry f where not exists (select port_id from port where depth > 4 except {GOALS}f.hull)",
    # optional facts, subtypes, rings
    "LIST n, r FROM Sailing has SailingNr n AND ALSO OPTIONALLY has Riders r": "select sailing_nr, riders from sailing",
    "LIST n, m FROM Ferry has FerryName n AND ALSO has relief Ferry has FerryName m": "select a.ferry_name, b.ferry_name from ferry a join ferry b on a.relief = b.hull",
    "LIST m FROM Ferry has relief Reliever [has FerryName: 'Albatros'] is relief of Ferry has FerryName m": "select c.ferry_name from ferry a join ferry b on a.relief = b.hull and b.ferry_name = 'Albatros' join ferry c on c.relief = b.hull",
    "LIST n, t FROM Icebreaker has FerryName n AND ALSO has Thickness t": "select ferry_name, thickness from ferry join icebreaker using (hull)",
    # windows, order, cuts
    "LIST n, r FROM Sailing has SailingNr n AND ALSO goes to Port p AND ALSO has Riders x AND ALSO THE RANK OF x WITHIN p AS r": "select sailing_nr, rank() over (partition by goal_port order by riders desc) from sailing where riders is not null",
    "LIST n, q FROM Sailing has SailingNr n AND ALSO has Fare x AND ALSO THE PREVIOUS x BY n WITHIN 1 AS q": "select sailing_nr, lag(fare) over (order by sailing_nr) from sailing",
    "LIST n, t FROM Ferry has FerryName n AND ALSO has Seats s AND ALSO THE SUM OF s WITHIN 1 AS t WHERE s > 100": "select ferry_name, 670 from ferry where seats > 100",
    "LIST n, t FROM Ferry has FerryName n AND ALSO has Seats s AND ALSO THE AVERAGE s WITHIN 1 AS m AND ALSO (s - m) AS t WHERE t > 0": "select ferry_name, seats - 158 from ferry where seats > 158",
    "LIST p, x FROM Sailing goes to Port has PortName p AND ALSO has Fare x AND ALSO has SailingNr n ORDERED WITH x DESCENDING, n THE FIRST 1 PER p": "select port_name, max(fare) from sailing join port on goal_port = port_id group by 1",
    "LIST n, x FROM Sailing has SailingNr n AND ALSO has Fare x ORDERED WITH x THE FIRST 3 WITH TIES": "select sailing_nr, fare from sailing where fare <= 12.5",
    "LIST n, x FROM Sailing has SailingNr n AND ALSO OPTIONALLY has Riders x ORDERED WITH x THE FIRST 1 WITH TIES": "select 4, null",
    "LIST f, c FROM Ferry x has Fuel f AND ALSO THE COUNT OF x GROUPED BY f AS c WHERE c > 1": "select fuel, count(*) from ferry group by 1 having count(*) > 1",
    # gathers
    "LIST f, l FROM Ferry has Fuel f AND ALSO has FerryName n AND ALSO THE LIST OF n SEPARATED BY ' + ' GROUPED BY f AS l": "select fuel, string_agg(ferry_name, ' + ' order by ferry_name) from ferry group by 1",
    "LIST l FROM THE LIST OF s IN Ferry has Seats s ORDERED WITH s DESCENDING THE FIRST 2 AS l": "select [350, 200]",
    "carries Cargo has Tonnes AS t EACH Sailing has Day d": "select sailing_nr, day, coalesce((select list(tonnes order by tonnes) from cargo c where c.sailing_nr = s.sailing_nr), []) from sailing s",
    # whole results, macros, dates
    "(LIST n FROM Ferry [has Fuel: 'diesel'] has FerryName n) MINUS (LIST n FROM Icebreaker has FerryName n) ORDERED WITH n": "select 'Albatros'",
    "(LIST p FROM Sailing starts in Port has PortName p) INTERSECTED WITH (LIST p FROM Ferry lies in Port has PortName p)": "select distinct port_name from port where port_id in (select start_port from sailing) and port_id in (select home from ferry)",
    "LIST n FROM Sailing has SailingNr n AND ALSO has Fare x WHERE dear(x)": "select sailing_nr from sailing where fare >= 20",
    "LIST n, y FROM Ferry has FerryName n AND ALSO has Built d AND ALSO year(d) AS y": "select unnest(['Albatros', 'Brise', 'Condor', 'Dorsch', 'Elster']), unnest([1998, 2019, 1987, 1931, 2022])",
}


def plain(rows):
    flat = lambda v: [flat(x) for x in v] if isinstance(v, (list, tuple)) else float(round(v, 9)) if isinstance(v, (int, float)) else v if v is None or isinstance(v, str) else float(v)
    return sorted((flat(r) for r in rows), key=str)


@pytest.mark.parametrize("text", ANSWERS)
def test_answer(ferries, duck, text):
    assert plain(ferries(text)) == plain(duck.sql(ANSWERS[text]).fetchall())


def test_order_is_kept(ferries):
    assert [r[0] for r in ferries("LIST n FROM Ferry has FerryName n AND ALSO has Seats s ORDERED WITH s DESCENDING")] == ["Condor", "Albatros", "Elster", "Brise", "Dorsch"]
    assert ferries("LIST n, r FROM Sailing has SailingNr n AND ALSO OPTIONALLY has Riders r ORDERED WITH r")[0] == (4, None)
    assert ferries("LIST n, r FROM Sailing has SailingNr n AND ALSO OPTIONALLY has Riders r ORDERED WITH r DESCENDING")[-1] == (4, None)
