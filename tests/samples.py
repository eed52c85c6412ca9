"""Small projects as literals."""

TYPESCRIPT = {
    "src/auth/index.ts": "export { authenticate } from './middleware.js';\nexport { verifyToken, signToken } from './jwt.js';\nexport type { JWTPayload } from './jwt.js';\n",
    "src/auth/jwt.ts": "import jwt from 'jsonwebtoken';\nimport { getConfig } from '../utils/config.js';\nexport interface JWTPayload { id: string }\nexport function signToken(p: JWTPayload) { return jwt.sign(p, getConfig().key); }\nexport function verifyToken(t: string) { return jwt.verify(t, getConfig().key); }\n",
    "src/auth/middleware.ts": "import { verifyToken } from './jwt.js';\nimport { getUserById } from '../db/index.js';\nimport type { Request } from 'express';\nexport async function authenticate(r: Request) { return getUserById(verifyToken(r.token).id); }\n",
    "src/db/connection.ts": "import { getConfig as settings } from '../utils/config.js';\nexport const getConnection = () => settings().url;\n",
    "src/db/index.ts": "export { getUserById, createUser } from './users.js';\nexport { getConnection } from './connection.js';\n",
    "src/db/users.ts": "import { getConnection } from './connection.js';\nexport function getUserById(id: string) { return [getConnection(), id]; }\nexport function createUser(name: string) { return [getConnection(), name]; }\n",
    "src/models/user.ts": "export interface User { id: string }\nexport type Role = 'a' | 'b';\n",
    "src/routes/auth.routes.ts": "import { signToken as sign } from '../auth/index.js';\nimport { getUserById } from '../db/index.js';\nexport const authRoutes = [sign, getUserById];\n",
    "src/routes/index.ts": "export { userRoutes } from './users.routes.js';\nexport { authRoutes } from './auth.routes.js';\n",
    "src/routes/users.routes.ts": "import { authenticate as guard } from '../auth/index.js';\nimport { getUserById } from '../db/index.js';\nexport const userRoutes = [guard, getUserById];\n",
    "src/utils/config.ts": "export function getConfig() { return { key: 'k', url: 'u' }; }\n",
}
PYTHON = {
    "app/auth/__init__.py": "from .middleware import check\nfrom .jwt import verify\n",
    "app/auth/middleware.py": "from .jwt import verify\nfrom app.models.user import User\nfrom app.services.auth_service import login\n\ndef check(t):\n    return verify(t)\n",
    "app/auth/jwt.py": "import hashlib\nfrom app.utils.config import get_config\n\ndef verify(t):\n    return get_config()\n",
    "app/models/__init__.py": "from .user import User\n",
    "app/models/user.py": "from app.utils.config import get_config\n\nclass User:\n    pass\n",
    "app/services/__init__.py": "from .auth_service import login\n",
    "app/services/auth_service.py": "from app.auth.jwt import verify\nfrom app.models.user import User\n\ndef login():\n    return verify\n",
    "app/utils/__init__.py": "from .config import get_config\n",
    "app/utils/config.py": "DEBUG = True\n\ndef get_config():\n    return DEBUG\n",
}
GO = {
    "cmd/main.go": 'package main\n\nimport (\n\t"net/http"\n\t"fmt"\n\t"github.com/example/myapp/pkg/auth"\n\t"github.com/example/myapp/pkg/handlers"\n)\n\nfunc main() { fmt.Println(auth.Sign(), handlers.Router(), http.StatusOK) }\n',
    "pkg/auth/auth.go": 'package auth\n\nimport "crypto/hmac"\n\nconst Secret = "s"\n\ntype Token struct {\n\tID string\n}\n\nfunc Verify(t Token) bool { return true }\n\nfunc Sign() string { return internalHelper() }\n\nfunc internalHelper() string { return Secret }\n',
    "pkg/db/db.go": 'package db\n\nimport "database/sql"\n\nfunc Open() *sql.DB { return nil }\n',
    "pkg/handlers/router.go": 'package handlers\n\nimport (\n\t"encoding/json"\n\t"github.com/example/myapp/pkg/auth"\n\t"github.com/example/myapp/pkg/db"\n)\n\nfunc Router() string { return "" }\n',
}


def write(root, project):
    for name, text in project.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)
