from .service import main

raise SystemExit(main())
