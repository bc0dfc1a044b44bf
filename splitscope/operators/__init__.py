"""DataFrame -> DataFrame operators of the experiment workflow."""
