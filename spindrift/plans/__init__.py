"""Options, parameter grids and the session that ties operators together."""
