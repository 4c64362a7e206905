"""The Go reader: what parses, what is called, what is declared."""

import pytest

from sessionlens.functions.go_syntax import declarations, exported_calls, read_file, read_snippet

FILE = '''// Package p.
package p

import (
	"fmt"
	. "strings"
	alias "x/y"
)

import "os"

type (
	Num interface{ ~int | ~int64; String() string; fmt.Stringer }
	Pair[K comparable, V any] struct {
		Key K `json:"key"`
		Val, Other V
		*alias.Base
		Inner[V]
		list []V
		arr [3]int
		f func(a, b int, rest ...string) (n int, err error)
		ch <-chan map[string][]*V
	}
	Alias = map[string]struct{}
)
type Arr [Size * 2]int
type I interface { FooBar(x int) error }

const (
	A, Size = iota, 1 << 3
	B, _
)

var x, Y int = 1, Make(2)
var table = [...]struct{ n string; v int }{{"a", 1}, {n: "b", v: Value(2)}, 5: {}}

func (p *Pair[K, V]) Method(_ int) (V, error) {
	if v, ok := p.m[Key{1, 2}]; ok && len(v) > 0x1F {
		return Convert[V](v), nil
	} else if err := Check(func() bool { return true }()); err != nil {
		goto done
	}
	for i := 0; i < 10; i++ { Loop(i) }
	for range 10 {}
	for k, v := range (Range{k}) { _ = k; v.Selected() }
	for { break }
	for p.ok {}
outer:
	for ; ; {
		select {
		case x := <-ch: continue outer
		case ch <- Send(1):
		default:
		}
	}
	switch y := z.(type) {
	case []int, map[string]int, nil: Typed(y)
	case func(int) string, *T, chan<- int:
	default:
		fallthrough
	}
	switch { case a > 1, b: }
	switch x := 5; x { case 1: }
	defer func() { recover() }()
	go Worker(a, b...)
	s := a[1:], b[:2:3], c[:], d[i]
	f.g.Hidden(1)
	(Paren)(x)
	m := map[string][]int{"a": {1, 2}, `b`: nil}
	*q, w.z = <-ch, &T{A: 1}
	var local Local
	q.x++
	type inner struct{}
done:
	return Outer(Nested(1), 'x', '\\n', "\\u00e9", 1e-3, 0b11, .5i), x.(*T).y
}

func Generic[T Num, U interface{ ~[]T }](a T, fn func(T) U) U { return fn(a) }
func external(int, string)
'''


def test_a_file_of_everything():
    got = read_file(FILE)
    assert got is not None
    assert [(d.kind, d.name) for d in got.declared] == [
        ("package", "p"), ("type", "Num"), ("type", "Pair"), ("type", "Alias"), ("type", "Arr"), ("type", "I"), ("const", "A"), ("const", "Size"), ("const", "B"), ("const", "_"),
        ("var", "x"), ("var", "Y"), ("var", "table"), ("method", "Method"), ("func", "Generic"), ("func", "external"),
    ]
    assert all(FILE[d.position :].startswith(d.name) for d in got.declared)
    assert exported_calls(FILE) == []  # a snippet is a file only if it begins with its package line
    assert exported_calls(FILE.split("\n", 1)[1]) == ["Make", "Value", "Check", "Loop", "Send", "Typed", "Worker", "Outer", "Nested"]


@pytest.mark.parametrize(
    "text, calls",
    [
        ("package p\n\nfunc Foo(x int) int {\n\treturn Bar(x)\n}\n\nfunc run() {\n\tobj.Method(1)\n\tq := Qux(2)\n\t_ = q\n}\n", ["Bar", "Qux"]),
        ("package p\n\nfunc run() {\n\tsrc := `result := ComputeTotally(5)`\n\t_ = src\n\t// also NotAFunction(1) in a comment\n}\n", []),
        ("type I interface { FooBar(x int) error }", []),
        ("x := 1 2\nFooBar(x)", []),
        ("x := FooBar(1)\nif x { Other(x, Inner()) }", ["FooBar", "Other", "Inner"]),
        ("func a() { Foo() }", ["Foo"]),
        ("import \"fmt\"\nfunc a() { Foo() }", ["Foo"]),
        ("func a() {}\nimport \"fmt\"\nvar x = Foo()", []),
        ("Fo(1)\nlower(2)\nFoo(3)\nFoo(4)", ["Foo"]),
        ("Foo(1", []),
        ("s := \"unfinished\nFoo(1)", []),
        ("for i := range Items() { Use(i) }", ["Items", "Use"]),
        ("if T{1} == x { Foo() }", []),
        ("if (T{1}) == x { Foo() }", ["Foo"]),
        ("a, b\nFoo()", []),
        ("go Foo\n", []),
        ("func(a, b int, string) {}\nFoo()", []),
        ("return Foo(\n\t1,\n\t2,\n)", ["Foo"]),
        ("return Foo(\n\t1,\n\t2\n)", []),
        ("x := '\\q'\nFoo()", []),
        ("/* a\nb */ Foo() /* c */", ["Foo"]),
        ("Ünter(1)\nÉtat(2)", ["Ünter", "État"]),
        ("", []),
    ],
)
def test_calls(text, calls):
    assert exported_calls(text) == calls


def test_broken_file_declares_nothing():
    assert [d.name for d in declarations("package p\nfunc A() { x := 1 }\n")] == ["p", "A"]
    assert declarations("package p\nfunc A() { x := 1 2 }\n") == []
    assert declarations("func A() {}\n") == []
    assert read_snippet("(" * 5000) is None


def test_calls_leave_their_texts_before_joins(spark):
    """Edits of one tree have one key, tree and language: neither they nor their texts are dealt out by it."""
    from sessionlens.operators import symbols
    from sessionlens.plans import bindings, queries

    frames = queries.go_edits(bindings.table(spark, "/root/testdata/sf0.001", "pages"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = symbols.undefined_calls(frames.events, frames.sessions, frames.files)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    semi = [x for x in plan.splitlines() if "LeftSemi" in x and "language#" in x]  # the tree is a constant here
    assert semi and all("BroadcastHashJoin" in x for x in semi)
