"""Column functions: every helper returns a ``Column`` built from built-in
Spark SQL expressions, so it stays inside whole-stage codegen (or, for the
higher-order array functions, inside the JVM)."""
