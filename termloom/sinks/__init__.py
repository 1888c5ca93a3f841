"""Writers of rendered files and their manifest."""
