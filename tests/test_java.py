"""The Java front end: parsing, rules, flow inside methods, control dependence."""

from tracelake.schema import BRANCHES, NODE_KINDS
from tracelake.sources.java_flow import Names, declared, lowered
from tracelake.sources.java_rules import Rules, compiled, load
from tracelake.sources.java_syntax import parse

RULES = Rules(load())


def rows(*texts):
    known = {}
    for t in texts:
        unit, _ = parse(t)
        known |= declared(unit, Names(unit, {}), RULES)
    return [r for t in texts for r in lowered(t, known, RULES)]


def of(found, what):
    return [r for w, r in found if w == what]


def named(found):
    return {(r["sig"], r["lid"]): r["name"] for r in of(found, "node")}


def uses(found, method):
    n = named(found)
    return {(n[r["sig"], r["src"]], n[r["sig"], r["dst"]]) for r in of(found, "edge") if r["kind"] == "DEF_USE" and f"#{method}(" in r["sig"]}


def control(body, params="int a, int b, boolean c"):
    found = rows(f"class K {{ int out; int call(int v) {{ return v; }} int m({params}) {{ {body} }} }}")
    n = named(found)
    keep = lambda x: not x.endswith("]") and "load" not in x
    return {f"{n[r['sig'], r['src']]} {BRANCHES[r['label']]}{r['case_val'] and ' ' + r['case_val']} {n[r['sig'], r['dst']]}" for r in of(found, "edge") if r["kind"] == "CONTROL" and "#m(" in r["sig"] and keep(n[r["sig"], r["dst"]])}


def test_parser_reads_all_of_java():
    text = """
    package p.q; import java.util.*; import static a.B.*; import x.Y;
    @Entity(name = "t", tags = {"a", "b"}) public abstract class C<T extends Comparable<T>> extends D<T> implements E, F<Map<String, List<T>>> {
        enum Kind { ONE("1") { @Override int f() { return 1; } }, TWO; int f() { return 2; } }
        record Point(int x, int y) { Point { if (x < 0) throw new IllegalArgumentException("x" + x); } }
        @interface Note { String value() default "v"; }
        private final Map<String, int[]> m = new HashMap<>(), n; static { init(); }
        <R> C(R r, int... rest) throws Exception { this(); super.go(); }
        public <A, B> Map<A, B> gen(final List<? extends A> in, @Note("p") B[] out) {
            int x = 0b1010, y = 0xFFL > 3 ? x >>> 2 : (int) 'c', z = -x; long[] q = {1, 2}, w = new long[3];
            for (int i = 0, j = 1; i < 10 && j >> 1 < 3; i++, j += 2) { if (i == 3) continue; else break; }
            outer: for (var e : in) { do { x <<= 1; } while (x < 5); while (true) { break outer; } }
            Runnable r = () -> {}; Function<A, B> f = a -> b(a); BiFunction<A, B, A> g = (a, b) -> a; Supplier<C> s = C::new;
            String t = switch (x) { case 1, 2 -> "a"; case 3 -> { yield "b"; } default -> throw new X(); };
            switch (o) { case Point(int a, var b) when a > 1 -> x = a; case String v -> x = 1; case null, default -> {} }
            try (var in2 = open(); other) { in.get(0).<A>run().x[1].y++; } catch (IOException | X e) { throw e; } finally { close(); }
            synchronized (this) { assert x > 0 : "no"; } if (o instanceof String v2 && !v2.isEmpty()) return null;
            Object anon = new Object() { int z2; @Override public String toString() { return "" + z2; } };
            String block = \"\"\"
                a "quoted" line
                \"\"\"; label: { break label; } ; class Local { } return (Map<A, B>) (Object) anon;
        }
        abstract int later(String a, int b[]);
    }
    """
    unit, parser = parse(text)
    (c,) = unit.types
    assert parser.errors == 0 and unit.package == "p.q" and (c.extends, c.implements) == ("D", ["E", "F"])
    assert [m.name for m in c.methods] == ["", "<init>", "gen", "later"] and [t.name for t in c.types] == ["Kind", "Point", "Note"]
    assert [(p.name, p.type) for p in c.methods[2].params] == [("in", "List"), ("out", "B[]")] and [f.name for f in c.fields] == ["m", "n"]


def test_parser_skips_what_is_broken():
    unit, parser = parse("class A { int bad(String x) { int y = x.length( + ; return y; } int ) ; int good() { return 1; } } class B { int f( }")
    assert parser.errors >= 2 and [m.name for m in unit.types[0].methods][0] == "bad" and unit.types[0].methods[0].broken
    assert "good" in [m.name for m in unit.types[0].methods]
    for text in ("", "class", "class A {", "}}}", "class A { void f() { if (", "@", "\x00", "class A { String s = \"abc\n; int x; }"):
        parse(text)
    found = rows("class A { int bad(String x) { int y = x.length( + ; return y; } int good(int v) { return v; } }")
    assert [(r["name"], r["abstract"]) for r in of(found, "method")] == [("bad", True), ("good", False)] and of(found, "problem")
    assert ("v", "return") in uses(found, "good")


def test_rules():
    text = """package g; @Service("main") @RequestMapping("/v1") @RequiredArgsConstructor public class OrderDesk {
      private final Store store; private Other other; @Autowired @Qualifier("fast") private Clock clock;
      @GetMapping(value = "/{id}/x") public String get(@PathVariable String id, @RequestParam(name = "q", required = false) String query, String plain) { return id; }
      @RequestMapping(path = "all", method = RequestMethod.DELETE) void drop() {} @PostMapping void make() {} }
    @Component class Till { private Store s; Till(@Qualifier("big") Store s) { this.s = s; } }
    @Mapper interface Rows { @Update({"update t", "set a = #{v}"}) int put(@Param("v") String w); }"""
    found = rows(text)
    assert [(r["verb"], r["path"], [p["name"] for p in r["params"]]) for r in of(found, "endpoint")] == [("GET", "/v1/{id}/x", ["id", "q"]), ("DELETE", "/v1/all", []), ("POST", "/v1", [])]
    assert [(r["name"], r["bean_name"], r["mapper"]) for r in of(found, "class")] == [("g.OrderDesk", "main", False), ("g.Till", "till", False), ("g.Rows", "", True)]
    assert {(r["name"], r["injected"], r["qualifier"]) for r in of(found, "field")} == {("store", True, ""), ("other", False, ""), ("clock", True, "fast"), ("s", True, "big")}
    (st,) = of(found, "statement")
    assert (st["sql"], st["binds"][0]["root"]) == ("update t set a = :__b0", "w")


def test_rules_of_users(tmp_path):
    (tmp_path / "own.json").write_text('[{"id": "my.bean", "on": "class", "annotations": ["Part"], "emit": "bean", "name": "lower(name(decl))"}, {"id": "spring.bean", "on": "class", "annotations": ["None"], "emit": "bean", "name": "name(decl)"}]')
    rules = Rules(load(tmp_path))
    unit, _ = parse("@Part class X {} @Service class Y {}")
    found = declared(unit, Names(unit, {}), rules)
    assert found["X"]["bean_name"] == "x" and not found["Y"]["bean"]
    assert compiled("lookup('a', a='1', default='2')")({}) == "1" and compiled("concatPath('/x/', coalesce('', 'y'))")({}) == "/x/y" and compiled("decap(simpleName('a.Bc'))")({}) == "bc"


def test_definitions_and_uses():
    found = rows(
        """package p; class Q { String f; Q other; static final String SQL = "SELECT 1 FROM T WHERE A = ?"; JdbcTemplate db;
        String chain(String a, String b) { String x = a.trim() + b; if (b.isEmpty()) { x = a; } String[] arr = new String[2]; arr[0] = x; f = arr[1]; return this.f; }
        String loop(String a, java.util.List<String> all) { String out = ""; for (String s : all) { out = out + s; } while (out.length() > 3) { out = out.substring(1); } return out; }
        String maybe(String a, String b, boolean c) { return c ? a : b; }
        String build(String a) { StringBuilder sb = new StringBuilder(); sb.append(a); return sb.toString(); }
        int sql(String v) { return db.update(SQL + " OR B = ?", v, f); }
        void set(Q q, String v) { q.setF(v); q.f = v; other.set(q, q.getF()); }
        String names(java.util.List<String> all) { return all.stream().map(s -> s.trim()).toString(); } }"""
    )
    u = uses(found, "chain")
    assert {("a", "trim() result"), ("trim() result", "x#1"), ("b", "x#1"), ("a", "x#2"), ("load Q.f", "return")} <= u and ("x#3", "arr#2") in u and ("arr#2", "store Q.f") in u
    u = uses(found, "loop")
    assert ("all", "s#1") in u and any(a.startswith("out#") and b == "return" for a, b in u)
    assert uses(found, "maybe") >= {("a", "return"), ("b", "return")}
    assert {("a", "append() result"), ("a", "sb#2"), ("sb#2", "toString() result")} <= uses(found, "build")
    (st,) = of(found, "statement")
    assert st["sql"] == "SELECT 1 FROM T WHERE A = :__b0 OR B = :__b1" and st["sig"].startswith("p.Q#sql$sql1@L")
    assert {(r["field"], r["stored"]) for r in of(found, "access") if "#set(" in r["sig"]} == {("p.Q.f", True), ("p.Q.f", False), ("p.Q.other", False)}
    assert ("trim() result", "map() result") in uses(found, "names")
    assert {NODE_KINDS[r["kind"]] for r in of(found, "node")} >= {"FORMAL_IN", "FORMAL_OUT", "ACTUAL_IN", "ACTUAL_OUT", "LOCAL", "PREDICATE", "FIELD_LOAD", "FIELD_STORE"}


def test_calls():
    found = rows(
        "package p; import q.*; class A extends Base { Helper h; int go(int a) { return twice(a) + Helper.make(a) + h.run(a) + up(a) + super.up(a) + new Helper(a).run(a); } int twice(int x) { return x; } }",
        "package p; class Base { int up(int x) { return x; } }",
        "package q; public class Helper { Helper(int s) { } static int make(int x) { return x; } int run(int x) { return x; } int run(int x, int... more) { return x; } }",
    )
    calls = {(r["name"], r["kind"], r["receiver_type"], tuple(r["candidates"])) for r in of(found, "call")}
    assert calls == {
        ("twice", "THIS", "p.A", ("p.A#twice(int)",)), ("make", "STATIC", "q.Helper", ("q.Helper#make(int)",)), ("run", "VIRTUAL", "q.Helper", ("q.Helper#run(int)",)),
        ("up", "THIS", "p.A", ("p.Base#up(int)",)), ("up", "SUPER", "p.Base", ("p.Base#up(int)",)), ("<init>", "CONSTRUCTOR", "q.Helper", ("q.Helper#<init>(int)",)),
    }


def test_control_dependence():
    assert control("int x = 0; if (a > 1) { x = 1; } else if (b > 2) { x = 2; } else { x = 3; } return x;") == {
        "a > 1 TRUE x#2", "a > 1 FALSE b > 2", "b > 2 TRUE x#3", "b > 2 FALSE x#4",
    }
    assert control("if (a == 0) { return 1; } int x = b; return x;") == {"a == 0 FALSE x#1", "a == 0 FALSE return@L1"}
    assert control("int x = 0; if (c && a > 1) { x = a; } return x;") == {"c TRUE a > 1", "a > 1 TRUE x#2"}
    assert control("int x = 0; if (c || a > 1) { x = a; } return x;") == {"c FALSE a > 1", "c TRUE x#2", "a > 1 TRUE x#2"}
    assert control("int x = 0; while (a > 0) { x = b; if (c) { break; } x = a; } return x;") == {"a > 0 TRUE x#3", "a > 0 TRUE c", "c FALSE x#4", "c FALSE a > 0"}
    assert control("int x = 0; switch (a) { case 1: x = 1; case 2: x = 2; break; default: x = 3; } return x;") == {
        "switch (a) CASE 1 x#2", "switch (a) CASE 1 x#4", "switch (a) CASE 2 x#4", "switch (a) DEFAULT x#5",
    }
    assert control("int x = 0; try { x = call(a); } catch (Exception e) { x = 2; } return x;") == {"EXC(try#1) EXCEPTION e#1", "EXC(try#1) EXCEPTION x#3"}
    assert control("int x = 0; do { x = a; } while (b > x); return x;") == {"b > x TRUE x#3"}
    assert control("int x = 0; for (int i = 0; i < a; i++) { if (i == b) continue; x = i; } return x;") == {"i < a TRUE i == b", "i == b FALSE x#3", "i < a TRUE i#3"}
    assert control("while (true) { if (c) { return a; } }") == set()  # the return always runs in the end
