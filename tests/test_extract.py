from wherry.operators.extract import calls, extract_source, symbols

PY = '''
class Base:
    def run(self):
        """Runs."""
        return helper(1)

class Child(Base):
    def go(self):
        self.run()
        self.run()
        os.path.join("a")

def helper(x):
    return x
'''
GO = """package a

// Reader reads.
type Reader struct {
\tx int
}

// Read reads it.
func (r *Reader) Read(p []byte) int {
\treturn parse(p)
}

func parse(p []byte) int {
\tfmt.Println("x {")
\treturn 1
}
"""
TS = """
export class Box {
  open(key: string): void {
    unlock(key);
  }
}
export const unlock = (key: string) => {
  return check(key);
};
"""


def names(language, source):
    return {(s[2], s[3]) for s in extract_source(f"m.{language}", language, source)[0]}


def test_python():
    s, c = extract_source("pkg/m.py", "python", PY)
    assert {(x[2], x[3]) for x in s} == {("m.Base", "class"), ("m.Base.run", "method"), ("m.Child", "class"), ("m.Child.go", "method"), ("m.helper", "function")}
    assert {(x[1], x[2]) for x in c} == {("m.Base.run", "helper"), ("m.Child.go", "m.Base.run"), ("m.Child.go", "os.path.join")}
    assert next(x for x in s if x[2] == "m.Base.run")[7] == "Runs."


def test_go():
    s, c = extract_source("a.go", "go", GO)
    assert {(x[2], x[3], x[4], x[5]) for x in s} == {("a.Reader", "type", 4, 6), ("a.Reader.Read", "method", 9, 11), ("a.parse", "function", 13, 16)}
    assert ("a.Reader.Read", "parse") in {(x[1], x[2]) for x in c}
    assert next(x for x in s if x[2] == "a.Reader.Read")[7] == "// Read reads it."


def test_typescript():
    assert names("typescript", TS) == {("m.Box", "class"), ("m.Box.open", "method"), ("m.unlock", "function")}


def test_others():
    assert ("m.A.f", "method") in names("java", "public class A {\n  public int f(int x) {\n    return g(x);\n  }\n}\n")
    assert ("m.S.f", "method") in names("rust", "struct S;\nimpl S {\n  pub fn f(&self) -> i32 {\n    1\n  }\n}\n")
    assert ("m.K.f", "method") in names("ruby", "class K\n  def f\n    g(1)\n  end\nend\n")
    assert names("klingon", "x") == set() and extract_source("a.py", "python", "def (") == ([], [])


def test_frames(spark):
    df = spark.createDataFrame([("pkg/m.py", "python", PY), ("a.go", "go", GO), ("x", None, None)], "path string, language string, source string")
    assert symbols(df).count() == 8
    assert calls(df).filter("callee = 'parse'").count() == 1
