"""The Verilog front end, on designs small enough to follow by hand."""

import itertools

import pytest
from affinis.verilog import control, dataflow, frames, text
from affinis.verilog.elaborate import bit_ranges, elaborate
from affinis.verilog.syntax import VerilogError, flat, parse, parse_expression, tokens, written, written_module
from affinis.verilog.values import apply, evaluate, optimised

FSM = """
module ctrl #(parameter IDLE = 2'd0, parameter RUN = 2'd1) (input clk, input rst, input go, input halt, output reg [1:0] state, output busy);
  localparam DONE = 2'd2;
  wire [1:0] other;
  assign busy = (state == RUN) ? 1'b1 : 1'b0;
  assign {other[1], other[0]} = {go, halt};
  always @(posedge clk or negedge rst) begin
    if (!rst) state <= IDLE;
    else case (state)
      IDLE: if (go) state <= RUN;
      RUN: if (halt) state <= DONE; else state <= RUN;
      DONE: state <= IDLE;
      default: state <= IDLE;
    endcase
  end
endmodule
module top(input clk, input rst, input [3:0] a, output [3:0] y, output [1:0] s);
  wire g = a[0] & a[1];
  wire busy;
  ctrl #(.RUN(2'd3)) c0 (.clk(clk), .rst(rst), .go(g), .halt(a[2]), .state(s), .busy(busy));
  function [3:0] twice; input [3:0] x; begin twice = x + x; end endfunction
  reg [3:0] t; integer i;
  always @(*) begin
    t = 4'd0;
    for (i = 0; i < 4; i = i + 1) t = t ^ (a >> i);
  end
  genvar k;
  generate for (k = 0; k < 2; k = k + 1) begin : bits
    assign y[k] = a[k] ^ busy;
  end endgenerate
  assign y[3:2] = twice(t);
endmodule
"""


@pytest.fixture(scope="module")
def design():
    return elaborate(parse(FSM))


def test_tokens_and_precedence():
    assert [t[1] for t in tokens("a<=b /* c */ + 4'hF // d")] == ["a", "<=", "b", "+", "4'hF"]
    assert written(parse_expression("a + b * c == d")) == "((a + (b * c)) == d)"
    assert written(parse_expression("x[7 -: 2]")) == "x[7:((7 - 2) + 1)]"
    with pytest.raises(VerilogError):
        parse("module m; assign = 1; endmodule")


def test_printing_is_parsed_back():
    def shape(m):
        return [r[:5] for r in flat(m)]

    for m in parse(FSM):
        again = parse(written_module(m))[0]
        assert again.value == m.value
        assert written_module(again) == written_module(m)
        assert len(shape(again)) >= 10


def test_operators_against_python():
    for a, b in itertools.product([0, 1, 5, 12, 15], repeat=2):
        plain = {"Plus": a + b, "Minus": a - b, "Times": a * b, "And": a & b, "Or": a | b, "Xor": a ^ b, "Xnor": 15 - (a ^ b), "Sll": a << b, "Srl": a >> b, "Sra": a >> b, "LessThan": a < b, "GreaterThan": a > b, "LessEq": a <= b, "GreaterEq": a >= b, "Eq": a == b, "Eql": a == b, "NotEq": a != b, "NotEql": a != b, "Land": bool(a and b), "Lor": bool(a or b), "Power": a**b}
        assert {op: apply(op, [a, b], 4) for op in plain} == {op: int(v) for op, v in plain.items()}
        assert apply("Divide", [a, b]) == (a // b if b else None) and apply("Mod", [a, b]) == (a % b if b else None)
        bits = [a >> k & 1 for k in range(4)]
        unary = {"Uminus": -a, "Ulnot": not a, "Unot": 15 - a, "Uand": all(bits), "Unand": not all(bits), "Uor": any(bits), "Unor": not any(bits), "Uxor": sum(bits) % 2, "Uxnor": 1 - sum(bits) % 2}
        assert {op: apply(op, [a], 4) for op in unary} == {op: int(v) for op, v in unary.items()}
    assert evaluate(parse_expression("{2'b10, {2{1'b1}}}")) == 11
    assert evaluate(parse_expression("{2'b10, 1'b1}")) == 5
    assert evaluate(parse_expression("{3{2'b10}}")) == 42
    assert written(optimised(parse_expression("(a + 0) * 1 + (1 ? 2 * 3 : b)"))) == "(a + 6)"


def test_elaboration(design):
    assert design.instances == [("top", "top"), ("top.c0", "ctrl")]
    assert design.params["top.c0.RUN"] == 3 and design.params["top.c0.DONE"] == 2
    assert design.terms["top.a"].width == 4 and "input" in design.terms["top.a"].kinds
    kinds = {b.dest: b.kind for b in design.binds}
    assert kinds["top.c0.state"] == "clockedge" and kinds["top.t"] == "combination" and kinds["top.s"] == "assign"
    state = design.drivers("top.c0.state")[0]
    assert (state.clock, state.edge, state.reset, state.reset_edge) == ("top.c0.clk", "posedge", "top.c0.rst", "negedge")
    t = design.drivers("top.t")[0].tree
    assert [evaluate(t, {"top.a": a}) for a in (1, 8, 15)] == [1, 8 ^ 4 ^ 2 ^ 1, 15 ^ 7 ^ 3 ^ 1]
    y = bit_ranges([b for b in design.drivers("top.y")], 4)
    assert [(h, l) for h, l, _ in y] == [(3, 2), (1, 1), (0, 0)]
    assert {(b.dest, b.msb) for b in design.binds if b.dest.endswith("other")} == {("top.c0.other", 1), ("top.c0.other", 0)}
    with pytest.raises(VerilogError):
        elaborate(parse("module m(input clk, input d, output reg q); always @(posedge clk or d) q <= d; endmodule"))


def test_state_machine(design):
    moves = control.machines(design)["top.c0.state"]
    assert {(a, b) for a, b, _ in moves} == {(0, 3), (3, 2), (3, 3), (2, 0), (1, 0)}
    go = next(c for a, b, c in moves if (a, b) == (0, 3))
    assert "go" in go and next(c for a, b, c in moves if (a, b) == (2, 0)) is None
    assert control.loops(moves) == [(0, 3, 2), (3,)]
    assert control.label_range(moves) == (0, 3) and control.size(moves) == 5


def test_ranges():
    assert control.common([(0, 5)], [(3, 9)]) == [(3, 5)] and control.others([(2, 3)], 7) == [(0, 1), (4, 7)]
    test = parse_expression("(s > 2 || s == 0) && !(s >= 6) && go")
    ranges, rest = control.states(test, True, "s", 7, {})
    assert ranges == [(0, 0), (3, 5)] and written(rest) == "go"
    for value in range(8):  # a condition on the state alone: the ranges of both answers split all states
        for e in ("s < 3", "3 < s", "s != 4", "s == 1 || s == 6", "!(s <= 2) && s != 5"):
            want = bool(evaluate(parse_expression(e), {"s": value}))
            for holds in (True, False):
                inside = any(a <= value <= b for a, b in control.states(parse_expression(e), holds, "s", 7, {})[0])
                assert inside == (want == holds)


def test_dataflow(design):
    nodes, edges = dataflow.graph(design)
    labels = {e[2] for e in edges}
    assert {"COND", "TRUE", "FALSE", "VAR", "PTR"} <= labels
    names = {n[0] for n in nodes}
    assert {a for a, _, _ in edges} | {b for _, b, _ in edges} <= names
    assert {b.dest for b in dataflow.slice_of(design, ["top.s"])} >= {"top.s", "top.c0.state", "top.c0.go", "top.g", "top.c0.clk"}
    assert dataflow.sources(dataflow.inlined(design, "top.g")) == {"top.a"}
    assert dataflow.sources(dataflow.inlined(design, "top.s")) == {"top.c0.state"}
    code = dataflow.generated(dataflow.slice_of(design, ["top.s"]))
    assert "always @(posedge top.c0.clk or negedge top.c0.rst) begin" in code and "assign top.g = " in code
    assert dataflow.aliases_merged([("r", "a.b", ""), ("x", "a_b", ""), ("y", "c", "")], [("r", "y"), ("y", "x")]) == [("r", "y"), ("y", "r")]


def test_text():
    found = text.comments('a = "// no"; // yes\n/* two\nlines */ b')
    assert found == [("line", 1, 14, " yes"), ("block", 2, 1, " two\nlines ")]
    source = "`define W 8\n`define SUM(a, b) ((a) + (b))\n`ifdef W\nwire [`W-1:0] x = `SUM(f(1,2), 3);\n`else\nno\n`endif\n`ifndef W\nno\n`endif"
    assert text.preprocessed(source).strip() == "wire [8-1:0] x = ((f(1,2)) + (3));"
    flat_text = text.flattened("`define AB 3\n`define A 1\nparameter P = 4;\nassign x = `AB + `A + P;\n`ifdef 0\nno\n`else\nyes\n`endif")
    assert "assign x = 3 + 1 + 4;" in flat_text and "yes" in flat_text and "no" not in flat_text
    assert text.top_module("module a; endmodule module b; a u(); endmodule module c; endmodule") == "c"
    assert "module top" in text.with_top("module only; endmodule")
    assert text.hierarchy("module m(input a);\n  sub #(.W(2)) u0 (.a(a));\n  if (a) begin end\nendmodule") == ("m", [("u0", "sub")])
    assert text.qualified("m", ["clk", "u0_x"], [("u0", "sub")]) == ["m.clk", "m.u0.u0_x", "m.u0_x"]


def test_on_frames(spark):
    files = spark.createDataFrame([("d1/top.v", FSM), ("d1/top.v", FSM), ("d2/bad.v", "module ("), ("d3/none.v", None), ("d4/x.txt", "x")], "path string, text string")
    files = frames.scan_designs(files)
    assert {r.design for r in files.collect()} == {"d1", "d2", "d3"}
    assert {r.design for r in frames.problems(files).collect()} == {"d2", "d3"}
    moves = frames.state_machines(files).collect()
    assert {(r.design, r.src, r.dst) for r in moves} == {("d1", a, b) for a, b in [(0, 3), (3, 2), (3, 3), (2, 0), (1, 0)]}
    rows = frames.syntax_rows(files)
    assert rows.filter("parent is null").count() == 2 and frames.syntax_edges(files).count() == rows.count() - 2
    assert frames.graph_edges(files).count() > 30 and frames.graph_nodes(files).filter("type = 'branch'").count() > 3
    assert {r.path for r in frames.instances(files).collect()} == {"top", "top.c0"}
    assert frames.terms(files).filter("name = 'top.a' and width = 4").count() == 1
    assert frames.binds(files).filter("dest = 'top.c0.state' and clock = 'top.c0.clk'").count() == 1
    assert frames.driven_bits(files).filter("dest = 'top.y'").count() == 3
    assert frames.slices(files, ["top.s"]).filter("kind like 'clockedge%'").count() == 1
    assert frames.inlined_trees(files).filter("dest = 'top.g'").first().sources == ["top.a"]
    assert frames.path_conditions(files).filter("dest = 'top.c0.state' and not changes").count() >= 1
    assert frames.state_loops(files).filter("size(states) = 3").count() == 1
    assert '"roots":[1]' in frames.control_flow_records(files).first().record
    assert frames.generated_code(files).count() == 2
    assert frames.state_machines(files.limit(0)).count() == 0
