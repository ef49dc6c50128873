"""Compositions of the operators: the driver tables mapped to the reference's roles, and the
end-to-end dataset / evaluation flows."""
