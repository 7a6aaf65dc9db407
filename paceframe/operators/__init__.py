"""DataFrame -> DataFrame operators. No operator starts a job unless its docstring says so."""
