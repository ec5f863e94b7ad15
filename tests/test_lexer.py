"""Definitions and edges where strings, comments and nesting could mislead."""

from portolan.functions import extract, lexer

NESTED = '''package a;
import java.sql.Connection;
// class Ghost { }
/* public class Other {
   void no() { */
public class Outer extends Base {
  String s = "class Fake { def x() }";
  public interface Inner { void a(); }
  public static int run(int a,
      int b) {
    if (a > '{') { return one(1); } // two(2)
    return "three(3)".length();
  }
  protected abstract void later(int x);
  private static class Deep {
    public void deepest() { String t = """
       class Text { """; }
  }
}
class Next {}
'''
SCRIPT = """import os  # import sys
x = 1
'''
def ghost():
'''
class A(B):
    def f(self):
        s = 'class C: pass'
        def g(): # def h()
            return call(1)
        return g

    y = 2
def top(): pass
z = '''
class Q:
'''
"""
KIND = {"c": "class_definition", "f": "function_definition", "i": "import", "v": "variable"}
WANT = {
    "A.java": [("i", "java.sql.Connection", 1, 1, None), ("c", "Outer", 5, 18, None), ("c", "Inner", 7, 7, "Outer"), ("f", "run", 8, 12, "Outer"), ("c", "Deep", 14, 17, "Outer"), ("f", "deepest", 15, 16, "Deep"), ("c", "Next", 19, 19, None)],
    "m.py": [("i", "os", 0, 0, None), ("v", "x", 1, 1, None), ("c", "A", 5, 12, None), ("f", "f", 6, 11, "A"), ("f", "g", 8, 9, "f"), ("f", "top", 13, 13, None), ("v", "z", 14, 14, None)],
}


def test_strings_and_comments_define_nothing_and_blocks_nest(spark):
    f = spark.createDataFrame([("A.java", NESTED), ("m.py", SCRIPT), ("n.java", None), ("e.py", "")], "path string, content string")
    got = [tuple(r) for r in extract.definitions(f).orderBy("path", "start_line").collect()]
    assert got == [(p, KIND[k], *rest) for p in WANT for k, *rest in WANT[p]]


def test_edges_come_from_code_alone(spark):
    f = spark.createDataFrame([("A.java", NESTED), ("m.py", SCRIPT)], "path string, content string")
    e = {(r.src, r.dst) for r in extract.code_edges(extract.definitions(f), f).where("rel_type <> 'imports'").collect()}
    real = {("class:Outer", "class:Base"), ("function:run", "function:one"), ("function:run", "function:length"), ("class:A", "class:B"), ("function:g", "function:call")}
    assert e >= real
    assert not {d for _, d in e} & {f"function:{x}" for x in ("two", "three", "Fake", "h", "g", "run", "deepest", "x")}


def test_masks_keep_lines_and_places():
    for text, language in ((NESTED, "java"), (SCRIPT, "python"), ("let a = `x\n{`; // }\n'}'", "javascript"), ("'never closed", "ruby"), ("/* never closed {", None)):
        code = lexer.masked(text, language)
        assert len(code) == len(text) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
    assert lexer.masked("a = '{' + \"}\" // {\n", "javascript").split() == ["a", "=", "+"]


def test_unclosed_and_stray_braces():
    assert lexer.defined("} }\nclass A {\n  void x(;\n", "java") == [("class_definition", "A", 1, 3, None)]
    assert lexer.defined("public int a() {\n", "java") == [("function_definition", "a", 0, 1, None)]
