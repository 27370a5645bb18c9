"""The same results written as plain SQL, without grids, iteration or arrays where possible."""
