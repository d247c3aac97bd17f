"""A Verilog front end: syntax, elaboration to binds, data flow, conditions and state machines, on Spark by design."""
