"""Go and Java declarations: constructs, hard sources, and what must not count."""

import pytest

from ashlar.operators import curly

GO = '''// package no
package store /* func Hidden() {} */

import "os"
import (
	f "fmt"
	_ "embed"
	"a/b"
)

type (
	Key[K comparable, V any] struct {
		Base
		*pkg.Other `json:"o"`
		List[K]
		A, b int `json:"a,omitempty"`
		nested struct {
			X int
		}
		do func(a, b int) (int, error)
	}
	Names []string
)

type Reader interface {
	Read(p []byte) (n int, err error)
	io.Closer
}
type Row [8]byte

func (s *Store[K, V]) Get(key K, more ...int) (V, error) {
	if key == nil && s.ok || false { // if for
		return nil, errors.New("if { return }")
	}
	for i := range `for { } if` {
		go func() { x := '{'; _ = x }()
	}
	switch key.(type) {
	case int:
	default:
	}
	return s.m[key], nil
}

func Map[T any](xs []T, g func(T) T) interface{} { return nil }
func noBody(x int) int
func empty() {}
'''


def test_go():
    found = curly.go_source(GO)
    assert found["package"] == "store" and [(i["path"], i["alias"]) for i in found["imports"]] == [("os", None), ("fmt", "f"), ("embed", "_"), ("a/b", None)]
    f = {x["name"]: x for x in found["functions"]}
    assert sorted(f) == ["Get", "Map", "empty", "noBody"]
    get = f["Get"]
    assert (get["owner"], get["pointer"], get["exported"], get["parameters"], get["returns"]) == ("Store", True, True, ["key K", "more ...int"], "(V, error)")
    assert get["complexity"] == 1 + 1 + 2 + 1 + 1 + 1 + 1 + 2 + 1  # if, && ||, return, for, literal, switch, case and default, return
    assert (get["line_start"], get["line_end"]) == (31, 43)
    assert f["Map"]["type_parameters"] == ["T"] and f["Map"]["returns"] == "interface{}" and f["Map"]["complexity"] == 2 and f["noBody"]["complexity"] == 1
    t = {x["name"]: x for x in found["types"]}
    assert sorted(t) == ["Key", "Reader"] and t["Key"]["type_parameters"] == ["K", "V"]
    assert [(x["name"], x["type"], x["tag"], x["embedded"]) for x in t["Key"]["fields"]] == [
        ("Base", "Base", None, True), ("Other", "*pkg.Other", 'json:"o"', True), ("List", "List[K]", None, True), ("A", "int", 'json:"a,omitempty"', False), ("b", "int", 'json:"a,omitempty"', False),
        ("nested", "struct { X int }", None, False), ("do", "func(a, b int) (int, error)", None, False),
    ]
    assert t["Reader"]["methods"] == ["Read"] and t["Reader"]["bases"] == ["io.Closer"]


JAVA = '''package a.b; // class No {}
import java.util.*;
import static java.lang.Math.max;

@Service("x{")
@org.acme.Table(name = "t")
public final class Main<T extends Comparable<T>> extends Base<T> implements Runnable, java.util.function.Function<String, List<? super T>> {
  private static final Map<String, List<Integer>> M = new HashMap<>() {{ put("a;", of(1)); }};
  int[] x = {1, 2}, y;
  static { init(); }
  String s = """
     if (x) { return "no"; }
     """;
  public Main(int a) throws IOException, b.Broken { if (a > 0 && a < 3 || false) throw new IOException("if"); }
  @Override @GetMapping(path = "/x", q = {1})
  protected <R, S extends R> Map<R, List<S>> get(final Map<R, S> in, int... more) {
    /* if while for */ char c = '{';
    for (int i : more) { x = i > 0 ? i : 1; }
    do { i--; } while (i > 0);
    try { List<?> l = f(() -> { return 1; }); } catch (Exception e) { }
    switch (c) { case 'a': break; default: }
    return null;
  }
  abstract int none();
  enum Kind { A(1) { int f() { return 2; } }, B; Kind() {} int size() { return 1; } }
  record Point<Q>(int x, List<Q> ys) implements Shape { Point { check(x); } double area() { return 0; } }
  interface Shape { default double area() { return 1; } double len(); }
}
@interface Mark { String value() default "x"; }
'''


def test_java():
    found = curly.java_source(JAVA)
    assert found["package"] == "a.b" and [i["path"] for i in found["imports"]] == ["java.util.*", "java.lang.Math.max"]
    t = {x["name"]: x for x in found["types"]}
    assert {k: v["kind"] for k, v in t.items()} == {"Main": "class", "Kind": "enum", "Point": "record", "Shape": "interface", "Mark": "annotation"}
    main = t["Main"]
    assert main["bases"] == ["Base<T>", "Runnable", "java.util.function.Function<String, List<? super T>>"] and main["type_parameters"] == ["T"]
    assert main["annotations"] == ["Service", "Table"] and main["tags"] == ["db_op", "service"] and main["exported"] and main["methods"] == ["Main", "get", "none"]
    assert (main["line_start"], main["line_end"]) == (5, 28)
    assert [(f["name"], f["type"]) for f in t["Point"]["fields"]] == [("x", "int"), ("ys", "List<Q>")] and t["Point"]["bases"] == ["Shape"] and t["Point"]["methods"] == ["Point", "area"]
    assert t["Kind"]["methods"] == ["Kind", "size"] and t["Shape"]["methods"] == ["area", "len"]
    f = {(x["owner"], x["name"]): x for x in found["functions"]}
    made = f["Main", "Main"]
    assert made["returns"] is None and made["throws"] == ["IOException", "b.Broken"] and made["complexity"] == 1 + 1 + 2 + 1
    get = f["Main", "get"]
    assert (get["returns"], get["type_parameters"], get["modifiers"], get["annotations"], get["tags"]) == ("Map<R, List<S>>", ["R", "S"], ["protected"], ["Override", "GetMapping"], ["network"])
    assert get["parameters"] == ["final Map<R, S> in", "int... more"]
    # for, ?, do with its while, return of the lambda, catch, switch, case, default, return
    assert get["complexity"] == 10
    assert ("Main.Point", "area") in f and ("Main.Kind", "size") in f and f["Main", "none"]["complexity"] == 1


@pytest.mark.parametrize("read", [curly.go_source, curly.java_source])
@pytest.mark.parametrize("source", ["", "}", "func (", "type T struct {", "class A { void f() { if (", '"open', "`open", "/* open", "import", "import (", "type", "func", "@", "class", "record R(", "enum E { A", "package", "func f[", "\x00é日本 {}", "type T[", "func (r *R", "class A<T"])
def test_broken_sources_are_read_as_far_as_they_go(read, source):
    found = read(source)
    assert set(found) == {"package", "imports", "functions", "types"}


def test_deep_nesting_is_read_in_time():
    deep = "func f() {" + "{" * 20_000 + "if x {}" + "}" * 20_000 + "}\nfunc g() {}"
    assert [(x["name"], x["complexity"]) for x in curly.go_source(deep)["functions"]] == [("f", 2), ("g", 1)]
    assert curly.go_source("{" * 20_000)["functions"] == [] and curly.go_source(")" * 20_000 + "func f() {}")["functions"][0]["name"] == "f"


def test_table(spark):
    rows = [("a.go", "go", GO, 1), ("B.java", "java", JAVA, 2), ("n.go", "go", None, 3), ("e.java", "java", "", 4), ("p.py", "python", "x", 5), ("a.go", "go", GO, 1)]
    found = curly.declarations(spark.createDataFrame(rows, "path string, language string, content string, functions int")).cache()
    assert found.count() == 5 and curly.functions(found).where("path = 'a.go'").count() == 8 and curly.types(found).where("language = 'java'").count() == 5
    assert found.where("package IS NULL").count() == 2 and curly.declarations(spark.createDataFrame([], "path string, language string, content string")).count() == 0
