"""Plan shapes shared by the operators: exact ranking without a global sort,
exact quantiles without a global group, and pair grids without a cross join."""
